"""Model files that recognition may use: manifests, checksums, and the state of each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

#: What manifests may say, and the states of a model.
TASKS = ("ocr-text", "ocr-layout", "ocr-table", "quality-reviewer")
ENGINES = ("tesseract", "paddleocr", "paddleocr-vl", "mineru", "custom")
QUANTIZATIONS = ("fp32", "fp16", "int8", "none")
FALLBACKS = ("skip-task", "use-degraded-route", "fail-quality-gate")
STATES = ("not-downloaded", "importing", "verifying", "available", "degraded", "disabled")
#: States that may follow each.
NEXT = {
    "not-downloaded": {"importing", "disabled"},
    "importing": {"verifying", "not-downloaded", "disabled"},
    "verifying": {"available", "degraded", "not-downloaded", "disabled"},
    "available": {"verifying", "degraded", "disabled", "not-downloaded"},
    "degraded": {"verifying", "disabled", "not-downloaded"},
    "disabled": {"not-downloaded", "verifying"},
}


@dataclass(frozen=True)
class Manifest:
    name: str
    task: str
    engine: str
    version: str
    size: int
    files: dict[str, str] = field(default_factory=dict)
    quantization: str = "none"
    min_memory_mb: int = 0
    on_failure: str = "skip-task"

    def errors(self) -> list[str]:
        checks = {
            "name is empty": not self.name.strip(),
            "task is unknown": self.task not in TASKS,
            "engine is unknown": self.engine not in ENGINES,
            "version is empty": not self.version.strip(),
            "size is negative": self.size < 0,
            "quantization is unknown": self.quantization not in QUANTIZATIONS,
            "fallback is unknown": self.on_failure not in FALLBACKS,
            "a checksum is no SHA-256": any(len(d) != 64 or set(d.lower()) - set("0123456789abcdef") for d in self.files.values()),
        }
        return [message for message, wrong in checks.items() if wrong]

    def wrong_files(self, data: dict[str, bytes]) -> list[str]:
        """Files that are missing or whose contents have another checksum."""
        return [n for n, want in self.files.items() if hashlib.sha256(data.get(n, b"")).hexdigest() != want.lower() or n not in data]


class Registry:
    """Manifests and their states; listeners hear of every change."""

    def __init__(self):
        self._held: dict[str, tuple[Manifest, str]] = {}
        self.listeners: list[Callable[[str, str], None]] = []

    def add(self, manifest: Manifest) -> None:
        if found := manifest.errors():
            raise ValueError("; ".join(found))
        if manifest.name in self._held:
            raise ValueError(f"{manifest.name} is registered already")
        self._set(manifest, STATES[0])

    def _set(self, manifest: Manifest, state: str) -> None:
        self._held[manifest.name] = (manifest, state)
        for hear in self.listeners:
            hear(manifest.name, state)

    def state(self, name: str) -> str:
        return self._held[name][1]

    def move(self, name: str, state: str) -> None:
        manifest, now = self._held[name]
        if state not in STATES or state not in NEXT[now]:
            raise ValueError(f"{name} can't go from {now} to {state}")
        self._set(manifest, state)

    def check(self, name: str, data: dict[str, bytes]) -> str:
        """Import and verify a model's files; the state afterwards."""
        for state in ("importing", "verifying") if self.state(name) == STATES[0] else ("verifying",):
            self.move(name, state)
        self.move(name, "degraded" if self._held[name][0].wrong_files(data) else "available")
        return self.state(name)

    def usable(self, task: str) -> list[Manifest]:
        return [m for m, state in self._held.values() if m.task == task and state == "available"]
