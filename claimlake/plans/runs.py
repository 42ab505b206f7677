"""Whole runs over claim folders: parse, ingest, extract and merge, summarise, answer.

Answers of a model are written before anything reads them, so that no plan asks twice. A file or an answer that fails
drops its document alone, with the reason kept beside it.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prompts
from ..functions import text
from ..functions.registry import FIELDS
from ..operators import extract, generate, layout, ledger, merge
from ..sources import files, scratch
from ..sources.snapshots import Snapshots

KEYS = ["claim_id", "doc_idx", "name"]
STEPS = "claim_id string, doc_idx int, doc string, diary string, ledger string, error string"
DIARIES, SUMMARIES = "claim_id string, diary string", "claim_id string, summary string"
LEDGER_ROWS = "claim_id string, doc_idx int, doc string, line int, page string, field_name string, old_value string, new_value string"


def tuned(generator, use: str):
    """The generator with the role and temperature of a use; plain functions stay as they are."""
    return dataclasses.replace(generator, system=prompts.ROLES[use], temperature=prompts.TEMPERATURES[use]) if dataclasses.is_dataclass(generator) else generator


def parse(listed: DataFrame, form: str = "markdown", images: bool = True) -> DataFrame:
    """Ordered chunks of listed files (claim_id, doc_idx, name, content), tables as ``markdown`` or ``json``.

    Files are decoded once: their layout is written to the shared folder, without the bytes of images if these are not
    asked for, and all kinds of chunks are made from there.
    """
    decoded = files.decode(listed, False, *KEYS).where("error is null")
    decoded = decoded if images else decoded.withColumn("image", F.lit(None).cast("binary"))
    return layout.chunks(scratch.written(decoded, "layout"), KEYS, form)


def contents(listed: DataFrame, form: str = "markdown") -> DataFrame:
    """(claim_id, doc_idx, doc, content): page-annotated text of the files that hold any."""
    out = layout.content(parse(listed, form, images=False), KEYS, page_tags=True).where(F.length(text.strip(F.col("content"))) > 0)
    return out.select("claim_id", "doc_idx", F.col("name").alias("doc"), "content")


def updater(generator, prompt: str):
    """A function from (diary, document) to the model's answer."""
    return lambda diary, document: generator(prompts.fill(prompt, {"diary": diary, "document": document}))


def entries(steps: DataFrame) -> DataFrame:
    """Ledger entries of the rows of ``ledger.fold``."""
    return ledger.parse_ledger(steps.where("ledger is not null"), "ledger", "claim_id", "doc_idx", "doc")


def summaries(diaries: DataFrame, ledgers: DataFrame, generator, answers: generate.Answers | None = None) -> DataFrame:
    """(claim_id, summary): the model's summary of diary and ledger; claims whose answer holds none are left out."""
    both = diaries.select("claim_id", "diary").join(ledgers.select("claim_id", "ledger"), "claim_id", "left")
    filled = text.render(F.lit(prompts.load("summary")), {"diary": F.col("diary"), "ledger": F.coalesce("ledger", F.lit(prompts.template("ledger")))})
    ask = answers.ask if answers else generate.ask
    said = ask(both.withColumn("prompt", filled), tuned(generator, "summary"), "prompt", "claim_id")
    return said.select("claim_id", text.first_section(F.col("raw"), "SUMMARY").alias("summary")).where("summary <> ''")


def ingest(spark: SparkSession, root: str, generator, out: str | None = None, form: str = "markdown", answers: generate.Answers | None = None) -> str:
    """Fold the documents of every claim under ``root`` into diary, ledger and summary; returns where they are.

    Tables under ``out``: ``steps`` (one row per document, with errors), ``diary``, ``ledger`` and ``summary``, as
    snapshots that ``files.read_state`` reads. Each run starts its claims afresh: a claim without a readable document has
    the template as its diary and no entries. What a run replaces stays until the new is there, table by table; claims
    that are not under ``root`` stay as they are.
    """
    out = out or files.processed_root(root)
    listed = files.list_claims(spark, root)
    mine = scratch.written(listed.select("claim_id").distinct(), "claims")
    start = prompts.template("diary")
    steps = scratch.written(ledger.fold(contents(listed, form), updater(tuned(generator, "update"), prompts.load("update")), start), "steps")
    last = steps.groupBy("claim_id").agg(F.max_by("diary", "doc_idx").alias("diary"))
    diaries = scratch.written(mine.join(last, "claim_id", "left").select("claim_id", F.coalesce("diary", F.lit(start)).alias("diary")), "diaries")
    logged = scratch.written(entries(steps), "entries")
    summed = summaries(diaries, ledger.ledger_text(logged, prompts.template("ledger")), generator, answers)
    for name, rows, schema in (("steps", steps, STEPS), ("diary", diaries, DIARIES), ("ledger", logged, LEDGER_ROWS), ("summary", summed, SUMMARIES)):
        Snapshots(spark, f"{out}/{name}", schema).replace(rows, mine)
    return out


def extraction_prompt() -> str:
    return prompts.load("extraction").replace("{{fields}}", "\n".join(f"- {name} ({kind})" for name, kind in FIELDS))


def named(extractions: DataFrame, variant: str = "extraction", doc: str = "doc") -> DataFrame:
    """Add ``json``: the extraction as text with its document under ``_document``."""
    members = F.map_filter(F.try_variant_get(variant, "$", "map<string,variant>"), lambda k, _: k != "_document")
    whole = F.map_concat(members, F.create_map(F.lit("_document"), F.col(doc).cast("variant")))
    return extractions.withColumn("json", F.to_json(whole))


def merged(extractions: DataFrame) -> DataFrame:
    """One row (claim_id, json) per claim from rows (claim_id, doc_idx, doc, extraction): merged fields by path, then payments."""
    docs = extractions.select("claim_id", "doc_idx").distinct()
    fields = merge.merge_fields(extract.leaves(extractions, "extraction", "claim_id", "doc_idx", "doc"), docs)
    return merge.as_json(merge.final_claim(fields, extract.payments(extractions, "extraction", "claim_id", "doc_idx", "doc")))


def extract_and_merge(spark: SparkSession, root: str, generator, out: str | None = None, form: str = "markdown", answers: generate.Answers | None = None) -> str:
    """Ask for every document's fields and merge them into one record per claim; returns where the results are.

    Under ``out``: ``answers`` (raw answers and errors), ``extraction`` (JSON per document) and ``final_claim`` (JSON
    per claim), by claim. An answer that is no JSON object drops its document.
    With ``answers``, kept from earlier runs, only documents that are new or changed are asked about. Results that a run
    replaces stay until the new ones are written.
    """
    out = out or files.processed_root(root)
    listed = files.list_claims(spark, root)
    mine = scratch.written(listed.select("claim_id").distinct(), "claims")
    asked = generate.extract(contents(listed, form), tuned(generator, "extraction"), extraction_prompt(), "claim_id", "doc_idx", "doc", answers=answers)
    said = scratch.written(asked.drop("extraction"), "said")
    objects = said.withColumn("extraction", text.parse_json(F.col("raw"))).where(F.schema_of_variant("extraction").startswith("OBJECT"))
    kept = generate.succeeded(objects)
    results = {"answers": (said, "parquet"), "extraction": (named(kept).select("claim_id", "doc_idx", "doc", "json"), "parquet"), "final_claim": (merged(kept), "text")}
    for table, (rows, kind) in results.items():
        made = scratch.written(rows, table)
        files.write_by_claim(made, f"{out}/{table}", "overwrite", form=kind)
        files.clear(mine.join(made, "claim_id", "left_anti"), f"{out}/{table}")  # claims that have no results any more
    return out


def answer(contexts: DataFrame, generator, question: str, *keys: str, answers: generate.Answers | None = None) -> DataFrame:
    """(keys, answer, found, error): what each content says to a question; ``found`` is false where it says nothing."""
    filled = text.render(F.lit(prompts.load("question")), {"refusal": F.lit(prompts.REFUSAL), "question": F.lit(question), "context": F.col("content")})
    ask = answers.ask if answers else generate.ask
    raw = ask(contexts.withColumn("prompt", filled), tuned(generator, "question"), "prompt", *keys)
    said = text.strip(F.col("raw"))
    return raw.select(*keys, said.alias("answer"), (~said.contains(prompts.REFUSAL)).alias("found"), "error")


def sources_by_field(observed: DataFrame, *keys: str) -> DataFrame:
    """(keys, sources): the distinct documents over rows with an array ``sources``, in order of name."""
    return observed.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def as_document(chunks: DataFrame, name: str, extension: str, metadata: dict | None = None) -> str:
    """A document and its chunks as JSON text, in order; bytes are left out. One document bounds the size."""
    rows = [json.loads(r["record"]) for r in layout.as_records(chunks.orderBy("page", "order")).toLocalIterator()]
    return json.dumps({"filename": name, "extension": extension, "metadata": metadata or {}, "chunks": rows}, ensure_ascii=False)
