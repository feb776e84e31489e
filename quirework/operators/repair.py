"""Repair of conversions: proposals from warnings and routes, their application to blocks, and the verdict."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..plans import catalog

#: Least confidence of a repair, that of a safer target, and pairs that can be read back.
LEAST, SAFER = 0.6, 0.8
READ_BACK = ("md", "html", "txt", "json", "csv", "xml", "docx", "xlsx", "epub")
ACTIONS = ("replaceTextRun", "selectFallbackRoute", "adjustHeading", "mergeTable", "reorderBlocks", "retryOcr", "replaceAsset")
HANDLED = ACTIONS[:2]
#: Fixed value: the field by which a block of each kind is read.
FIELD_OF = {"heading": "text", "paragraph": "text", "quote": "text", "code": "code", "raw": "content", "image": "alt", "asset": "alt"}


def propose(conversions: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, action, target, confidence, evidence): a safer target for generated and restricted routes, and hints of lossy warnings.

    ``conversions`` has (doc_id, source, target), ``warnings`` (doc_id, severity, code, message).
    """
    rows = []
    for s, to in catalog.MATRIX.items():
        for t in to:
            if catalog.Planner().route(s, t).route_class in ("generated", "restricted"):
                safe = next((x for x in to if catalog.Planner().route(s, x).route_class == "recommended"), None)
                if safe:
                    rows.append((s, t, safe))
    safer = conversions.sparkSession.createDataFrame(rows, "source string, target string, safer string")
    routes = conversions.join(F.broadcast(safer), ["source", "target"]).select("doc_id", F.lit("selectFallbackRoute").alias("action"), F.col("safer").alias("target"), F.lit(SAFER).alias("confidence"), F.concat_ws("->", "source", "target").alias("evidence"))
    hint = warnings.filter("severity = 'lossy'").select("doc_id", F.regexp_extract("message", r"\[repair:(\w+)\]", 1).alias("action"), F.col("code").alias("target"), F.lit(LEAST).alias("confidence"), F.col("message").alias("evidence"))
    return routes.union(hint.filter(F.col("action") != ""))


def accepted() -> Column:
    """Whether an action is sure enough and known how to do."""
    return (F.col("confidence") >= LEAST) & F.col("action").isin(*HANDLED)


#: Proposals by plug-ins: (conversions, warnings) -> rows as those of ``propose``; one that fails proposes nothing.
VALIDATORS: list[Callable[[DataFrame, DataFrame], DataFrame]] = []
#: What an action does: (blocks of one document, action) -> (blocks, note), or None for the blocks if it can't.
HANDLERS: dict[str, Callable[[list[dict], dict], tuple[list[dict] | None, str]]] = {}


def register_validator(propose_more: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    VALIDATORS.append(propose_more)


def register_handler(action: str, handle: Callable[[list[dict], dict], tuple[list[dict] | None, str]]) -> None:
    if not action:
        raise ValueError("an action needs a name")
    HANDLERS[action] = handle


def replace_run(blocks: list[dict], action: dict) -> tuple[list[dict] | None, str]:
    """``before`` becomes ``after`` in the field that the action names, an item as items[3], or else in the one that the block's kind is read by."""
    at = action.get("block_idx")
    if at is None or not 0 <= at < len(blocks):
        return None, "target-block-not-found"
    block = blocks[at]
    named = action.get("field") or FIELD_OF.get(block["type"], "")
    item = re.fullmatch(r"items\[(\d+)\]", named)
    items = block.get("items") or []
    if item and int(item[1]) >= len(items):
        return None, "field-out-of-bounds"
    if not named:
        return None, "no-suitable-field"
    value, before = items[int(item[1])] if item else block.get(named), action.get("before") or ""
    if not isinstance(value, str) or not before or before not in value:
        return None, "before-not-found"
    new = value.replace(before, action.get("after") or "")
    changed = {"items": [*items[: int(item[1])], new, *items[int(item[1]) + 1 :]]} if item else {named: new}
    return [*blocks[:at], block | changed, *blocks[at + 1 :]], f"replaced-{named}"


def recommend_route(blocks: list[dict], action: dict) -> tuple[list[dict] | None, str]:
    """A safer target is named; ``convert.with_fallback`` takes it."""
    return blocks, f"fallback-recommended:{action['target']}" if action.get("target") else "missing-fallback-target"


HANDLERS |= {"replaceTextRun": replace_run, "selectFallbackRoute": recommend_route}


def propose_all(conversions: DataFrame, warnings: DataFrame) -> DataFrame:
    """``propose`` and what the registered validators add."""
    out = propose(conversions, warnings)
    for more in VALIDATORS:
        try:
            out = out.unionByName(more(conversions, warnings).select(*out.columns))
        except (ValueError, TypeError, PySparkException):
            continue
    return out


def apply(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(doc_id, blocks, outcomes) of documents (doc_id, blocks) after their actions (doc_id, seq, action, block_idx, field, before, after, target, confidence).

    A document's actions are done in order by their handlers; ``outcomes`` says of each whether it was applied, rejected or recommended, and why.
    """
    held = actions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "block_idx", "field", "before", "after", "target", "confidence"))).alias("actions"))
    both = docs.select("doc_id", "blocks").join(held, "doc_id", "left")
    handlers = dict(HANDLERS)  # goes to the tasks with the function

    def one(blocks: list[dict], steps: list[dict]) -> tuple[list[dict], list[dict]]:
        outcomes = []
        for step in steps:
            handle = handlers.get(step["action"])
            if (step["confidence"] or 0) < LEAST:
                new, note = None, "below-min-confidence"
            elif handle is None:
                new, note = None, "no-handler"
            else:
                try:
                    new, note = handle(blocks, step)
                except Exception as e:  # noqa: BLE001  a plug-in's fault is an outcome
                    new, note = None, f"handler-error:{type(e).__name__}"
            state = "rejected" if new is None else "recommended" if note.startswith("fallback-recommended") else "applied"
            blocks = blocks if new is None else new
            outcomes.append({"action": step["action"], "state": state, "note": note})
        return blocks, outcomes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(b or [], a or []) for b, a in zip(batch.column("blocks").to_pylist(), batch.column("actions").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b for b, _ in rows], pa.list_(m.BLOCK)), pa.array([o for _, o in rows], pa.list_(_OUTCOME))], names=["doc_id", "blocks", "outcomes"])

    return both.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, blocks array<{m.BLOCK_DDL}>, outcomes array<struct<action:string,state:string,note:string>>")


_OUTCOME = pa.struct([(k, pa.string()) for k in ("action", "state", "note")])


def replace_runs(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """Blocks with the text replacements (doc_id, block_idx, seq, before, after, confidence) done in order."""
    good = actions.filter(F.col("confidence") >= LEAST)
    steps = good.groupBy("doc_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("seq", "before", "after"))).alias("steps"))
    done = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<seq:int,before:string,after:string>>")), F.col("text"), lambda t, s: F.replace(t, s.before, s.after))
    out = blocks.join(steps, ["doc_id", "block_idx"], "left").withColumn("repaired", done)
    return out.withColumn("changed", ~F.col("repaired").eqNullSafe(F.col("text"))).withColumn("text", F.col("repaired")).drop("steps", "repaired")


def verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, decision): of (doc_id, n_warnings, downgrades, fingerprint, read_back) before and after repair."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, "doc_id")
    worse = (F.col("b.n_warnings") > F.col("a.n_warnings")) | (F.col("b.downgrades") > F.col("a.downgrades"))
    same = F.col("b.fingerprint") == F.col("b.read_back")
    return both.select("doc_id", F.when(worse, "failed-quality-gate").when(same, "verified").otherwise("degraded").alias("decision"))
