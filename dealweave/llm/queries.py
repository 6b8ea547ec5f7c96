"""Queries of the operators in this package and their SQL, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm.encoding import restore_encoding
from dealweave.llm.leakage import leaked_items
from dealweave.llm.packing import count_tokens, pack
from dealweave.llm.linkage import link_companies
from dealweave.llm.repeats import Deliveries, entity_keys, points, round_key
from dealweave.llm.variants import spelling_pairs
from dealweave.operators.instants import to_instants
from dealweave.session import dropped, table, written


def announcement_points(spark: SparkSession, d: str, entities: DataFrame, batches: str = "true") -> tuple[DataFrame, DataFrame]:
    """The points of the funding events of some batches, and the copies among these."""
    keep = ["company_name", "company_id", "investor_name", "investor_id", "round_type", "source_url", "ingested_at"]
    timed = to_instants(table(spark, d, "funding_events").filter(batches), table(spark, d, "feed_sources"), row_id="event_id", text="announced_at", source="source", keep=keep)
    return points(
        timed, entities, row_id="event_id", company="company_name", company_id="company_id", investor="investor_name", investor_id="investor_id",
        round_type="round_type", url="source_url", time_us="epoch_us", arrived="ingested_at",
    )


def deliver(spark: SparkSession, d: str, deliveries: int) -> Deliveries:
    """The batches of funding_events in their order, in so many deliveries of about as many rows, each checked against the history before it."""
    run = Deliveries(spark)
    ends = table(spark, d, "funding_events").agg(F.percentile_approx("batch_no", [k / deliveries for k in range(1, deliveries)])).first()[0] or []
    entities = entity_keys(table(spark, d, "objects"), entity_id="id", name="name")
    last = None
    for end in [*sorted(set(ends)), None]:
        # Rows without a batch_no belong to the first delivery.
        parts = [f"batch_no > {last}" if last is not None else None, f"batch_no <= {end}" if end is not None else None]
        of = " and ".join(filter(None, parts)) or "true"
        new, copies = announcement_points(spark, d, entities, of if last is not None else f"batch_no is null or {of}")
        run.accept(new, copies)
        dropped(new)  # the history has it
        last = end
    return run


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each event that repeats an earlier one, with the first of its announcement."""
    return deliver(spark, d, 2).repeats().select(F.col("first").alias("event_id_a"), F.col("row").alias("event_id_b")).distinct()


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """Each event without company_id and the company of objects that it is about, with a confidence."""
    keep = ["company_name", "company_id", "investor_id", "round_type", "amount_usd", "sector", "country", "source_url"]
    timed = to_instants(table(spark, d, "funding_events"), table(spark, d, "feed_sources"), row_id="event_id", text="announced_at", source="source", keep=keep)
    companies = table(spark, d, "objects").filter("id like 'c:%'")
    return link_companies(timed.withColumn("round", round_key(F.col("round_type"))), companies, table(spark, d, "sector_bridge"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_linked(spark, d).select("event_id", "object_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    funding, silence = table(spark, d, "funding_events"), table(spark, d, "silence_events")
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_name").alias("name"), F.col(f"{kind}_id").alias("entity"))
    mentions = of(funding, "investor").unionByName(of(silence, "investor")).unionByName(of(funding, "company"))
    return spelling_pairs(mentions, kind="kind", name="name", entity_id="entity").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container of 2,048 tokens and its place in it."""
    counts = written(count_tokens(table(spark, d, "documents"), row_id="doc_id", text="text"), "tokens")
    return pack(counts, row_id="doc_id", n_tokens="n_tokens")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each document that carries a passage of a test item, with the longest verbatim match."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left once those with leaked passages are removed."""
    docs = table(spark, d, "documents")
    return docs.join(p9_leaks(spark, d).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "lang", "source")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled document with its chain of encodings and its restored text."""
    return restore_encoding(table(spark, d, "documents"), row_id="doc_id", text="text", source="source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_linked, p5_found, p8_packed, p9_found, p9_leaks, p9_clean_documents, p10_found, p10_restored)}

ORACLE: dict[str, str] = {}
