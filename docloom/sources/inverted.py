"""A stored inverted index: postings clustered by term, in blocks that know their best score.

Four tables lie in one folder. ``rows`` numbers the passages in order of (document_id, chunk_id). ``blocks`` holds the
postings of a term in one shard of passages, 128 at a time, sorted by term inside small row groups and laid out by department:
a search reads the folders of the caller's departments and, of those, the pages of its terms only, and never a text. ``terms``
has the document frequencies, ``stats`` one row for each field.

A shard is a bounded number of passages, so one task scores one shard whatever the length of a posting list. It adds up terms from
the heaviest on. Once the terms that are left can't lift a new passage over the k-th best score, only passages
that can still get there go on, and blocks that hold none of them, or whose best score is too small, are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.skew import top_per_key
from docloom.functions.text import HAN
from docloom.operators.retrieval import FIELDS, analyze_index, fuzzy_terms, query_terms
from docloom.operators.topk import ROUND, TIE, _collect_bounded, _flat, arrow_schema
from docloom.session import cut_lineage
from docloom.settings import DEFAULTS, Settings

SHARD_ROWS = 65_536  # passages of a shard, about
BLOCK_ROWS = 128  # postings of a block
PUSHED_TERMS = 1_000  # so many terms are named in the filter of a scan; more are joined
ROW_GROUP_BYTES = 1 << 20
SLACK = 1e-7  # by how much a bound must miss the k-th score; scores are compared on nine places
FILTERED = ("level", "allowed_groups", "doctype", "effective_date", "superseded")


PARTIAL = "department_id string, shard int, field int, term string, row array<bigint>, tf array<int>, length array<int>, docs bigint, words bigint"
HELD_POSTINGS = 500_000  # postings that a task gathers into lists at a time


def _partial_lists(fields: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of a task's passages as lists for each (department, shard, field, term); ``docs`` and ``words`` add up to the passages and words of a field."""
    schema = arrow_schema(PARTIAL)
    keys = ["department_id", "shard", "field", "term"]

    def counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for place, field in enumerate(fields):
            lengths, values = _flat(batch.column(3 + place))
            if not len(values):
                continue
            coded = values.dictionary_encode()
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            cells, tf = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            at = cells // len(coded.dictionary)
            first = np.diff(at, prepend=-1) > 0  # one posting of each passage stands for it
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), np.full(len(at), field, np.int32), coded.dictionary.take(pa.array(cells % len(coded.dictionary)))]
            numbers = [batch.column(2).take(pa.array(at)), tf.astype(np.int32), lengths[at].astype(np.int32), first.astype(np.int64), np.where(first, lengths[at], 0).astype(np.int64)]
            yield pa.table(dict(zip([*keys, "row", "tf", "length", "docs", "words"], columns + numbers)))

    def gathered(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        sums = [("row", "list"), ("tf", "list"), ("length", "list"), ("docs", "sum"), ("words", "sum")]
        made = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate(sums)
        made = made.select([*keys, *[f"{name}_{how}" for name, how in sums]]).rename_columns(schema.names).cast(schema)
        yield from made.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held += counted(batch)
            if sum(t.num_rows for t in held) >= HELD_POSTINGS:
                yield from gathered(held)
                held = []
        if held:
            yield from gathered(held)

    return run


def build(index: DataFrame, folder: str, settings: Settings = DEFAULTS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of passages (the columns of ``search_index``), keyed by (document_id, chunk_id)."""
    spark = index.sparkSession
    size = index.agg(F.count("*").alias("n"), F.bool_or(F.col("text").rlike(HAN)).alias("han")).first()
    shards = max(1, -(-size.n // shard_rows))
    # Without ideographs the CJK analysis is the standard one: same terms, boost and frequencies, so the field adds nothing.
    searched = [(i, name) for i, (name, _) in enumerate(FIELDS) if size.han or name != "cjk"]
    tasks = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = ["document_id", "chunk_id"]
    ordered = index.select(*ids, "department_id", *FILTERED).repartitionByRange(tasks, *ids).sortWithinPartitions(*ids)
    # Rows grow with the order of the ids, so that the smaller row is also the smaller key.
    numbered = cut_lineage(ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    numbered.write.partitionBy("department_id").parquet(f"{folder}/rows")

    # Only keys are sorted and numbered; texts are read once, and nothing but lists of postings is written of them.
    analyzed = analyze_index(index.select(*ids, "title", "text", "heading_path").join(numbered.select(*ids, "department_id", "row", "shard"), ids))
    partial = cut_lineage(analyzed.select("department_id", "shard", "row", *[f"terms_{name}" for _, name in searched]).mapInArrow(_partial_lists([i for i, _ in searched]), PARTIAL))
    stats = partial.groupBy("field").agg(F.sum("docs").alias("n_docs"), F.sum("words").alias("words")).where("n_docs > 0")
    stats.select("field", "n_docs", (F.col("words") / F.col("n_docs")).alias("avg_len")).coalesce(1).write.parquet(f"{folder}/stats")
    # The only shuffle of postings: dealt as they are stored, so that lists are joined and laid out where they are.
    dealt = partial.select("department_id", "shard", "field", "term", F.arrays_zip("row", "tf", "length").alias("some")).repartition(tasks, "department_id", "shard")
    lists = dealt.groupBy("department_id", "shard", "field", "term").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("postings"))
    starts = F.sequence(F.lit(0), F.floor((F.size("postings") - 1) / block_rows).cast("int"))
    blocks = lists.select("department_id", "shard", "field", "term", F.posexplode(F.transform(starts, lambda i: F.slice("postings", i * block_rows + 1, block_rows))).alias("block", "p"))
    averages = F.broadcast(spark.read.parquet(f"{folder}/stats").select("field", "avg_len"))  # one row for each field
    k1, b = settings.bm25_k1, settings.bm25_b
    best = F.array_max(F.transform("p", lambda x: x["tf"] / (x["tf"] + k1 * (1 - b + b * x["length"] / F.col("avg_len")))))
    blocks = blocks.join(averages, "field").select("department_id", "shard", "field", "term", "block", F.col("p.row").alias("rows"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), best.alias("best"))
    laid_out = blocks.sortWithinPartitions("department_id", "term", "field", "shard", "block")
    laid_out.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", 1 << 15).partitionBy("department_id").parquet(f"{folder}/blocks")
    df = spark.read.parquet(f"{folder}/blocks").select("field", "term", F.size("rows").alias("n")).groupBy("field", "term").agg(F.sum("n").alias("df"))
    df.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/terms")


def _of_terms(table: DataFrame, asked: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The rows of a table that have an asked term: by a filter that reaches the scan while the terms are few."""
    if terms is None:
        terms = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(terms) > PUSHED_TERMS:
        return table.join(asked.select("term").distinct(), "term", "left_semi")
    # Else Spark hands a reader only the range of a longer list.
    table.sparkSession.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED_TERMS))
    return table.where(F.col("term").isin(terms))


def weights(spark: SparkSession, folder: str, queries: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(query_id, field, term, weight, avg_len) of the query's terms that the index has."""
    asked = query_terms(queries)
    stored = spark.read.parquet(f"{folder}/terms")
    if fuzzy:
        near = fuzzy_terms(stored.select("term"), asked.select("term"))
        closeness = 1 - F.col("distance") / F.least(F.length("asked"), F.length("term"))
        asked = asked.withColumnRenamed("term", "asked").join(near, "asked").withColumn("qtf", F.col("qtf") * closeness)
        asked = cut_lineage(asked.groupBy("query_id", "field", "term").agg(F.sum("qtf").alias("qtf")))
    boosts = F.element_at(F.array(*[F.lit(boost) for _, boost in FIELDS]), F.col("field") + 1)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(_of_terms(stored, asked), ["field", "term"]).join(F.broadcast(spark.read.parquet(f"{folder}/stats")), "field")
    return known.select("query_id", "field", "term", (boosts * F.col("qtf") * idf).alias("weight"), "avg_len")


@dataclass
class Work:
    """Blocks whose postings were added up, and blocks passed over."""

    read: int = 0
    skipped: int = 0


class Shard:
    """The blocks of some terms in one shard, ready to be scored."""

    def __init__(self, table: pa.Table, average: dict[int, float], k1: float, b: float):
        table = table.combine_chunks().sort_by([("field", "ascending"), ("term", "ascending"), ("block", "ascending")])
        lists = [table.column(name).combine_chunks() for name in ("rows", "tfs", "lengths")]
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        self.ends = np.concatenate([[0], np.cumsum(np.diff(lists[0].offsets.to_numpy()))])
        self.names, self.at = np.unique(flat[0], return_inverse=True)
        field = np.array(table.column("field").to_pylist(), np.int64)
        usual = np.array([average.get(f, 1.0) for f in range(len(FIELDS))])[np.repeat(field, np.diff(self.ends))] if len(field) else np.zeros(0)
        self.part = flat[1] / (flat[1] + k1 * (1 - b + b * flat[2] / usual))
        self.best = table.column("best").to_numpy()
        self.blocks: dict[tuple[int, str], tuple[int, int]] = {}
        for place, key in enumerate(zip(field.tolist(), table.column("term").to_pylist())):
            self.blocks[key] = (self.blocks.get(key, (place,))[0], place + 1)

    def scores(self, asked: list[tuple[int, str, float]], k: int, allowed: np.ndarray | None, work: Work) -> np.ndarray:
        """Score of each passage: that of its best field. Below the k-th best, scores may be too small."""
        total, bar = np.zeros(len(self.names)), 0.0
        for field in sorted({f for f, _, _ in asked}):
            terms = []
            for f, term, weight in asked:
                if f == field and (f, term) in self.blocks:
                    low, high = self.blocks[f, term]
                    terms.append((weight * self.best[low:high].max(), weight, low, high))
            terms.sort(reverse=True)
            left = np.append(np.cumsum([t[0] for t in terms][::-1])[::-1], 0.0)
            sums = np.zeros(len(self.names))
            for turn, (_, weight, low, high) in enumerate(terms):
                if left[turn] >= bar - SLACK:  # a passage without any of the terms so far may still get there
                    span = slice(self.ends[low], self.ends[high])
                    sums[self.at[span]] += weight * self.part[span]
                    work.read += high - low
                    seen = sums if allowed is None else sums[allowed]
                    if len(seen) > k:
                        bar = max(bar, float(np.partition(seen, len(seen) - k)[len(seen) - k]))
                    continue
                open_ = np.flatnonzero(sums + left[turn] >= bar - SLACK)
                for block in range(low, high):
                    at = self.at[self.ends[block] : self.ends[block + 1]]
                    here = open_[np.searchsorted(open_, at[0]) : np.searchsorted(open_, at[-1], "right")]
                    if not len(here) or sums[here].max() + weight * self.best[block] + left[turn + 1] < bar - SLACK:
                        work.skipped += 1
                        continue
                    place = np.searchsorted(at, here)
                    hit = at[np.minimum(place, len(at) - 1)] == here
                    sums[here[hit]] += weight * self.part[self.ends[block] + place[hit]]
                    work.read += 1
            total = np.maximum(total, sums)
        return total if allowed is None else np.where(allowed, total, 0.0)


def _scorer(asked: pa.Table, k: int, settings: Settings, schema: pa.Schema) -> Callable[[pa.Table, np.ndarray | None], pa.Table]:
    by_query: dict = {}
    average = {}
    for query, field, term, weight, usual in zip(*(asked.column(c).to_pylist() for c in ("query_id", "field", "term", "weight", "avg_len"))):
        by_query.setdefault(query, []).append((field, term, weight))
        average[field] = usual

    def score(blocks: pa.Table, visible: np.ndarray | None) -> pa.Table:
        shard = Shard(blocks, average, settings.bm25_k1, settings.bm25_b)
        allowed = None if visible is None else np.isin(shard.names, visible)
        rows: list[tuple] = []
        for query, terms in by_query.items():
            found = np.round(shard.scores(terms, k, allowed, Work()), TIE)
            at = np.flatnonzero(found > 0)
            at = at[np.lexsort((at, -found[at]))[:k]]
            rows += [(query, row, value) for row, value in zip(shard.names[at].tolist(), found[at].tolist())]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return score


def topk(spark: SparkSession, folder: str, queries: DataFrame, groups: list[str], k: int, visible: Column | None = None, fuzzy: bool = False, settings: Settings = DEFAULTS) -> DataFrame | None:
    """``(query_id, document_id, chunk_id, score, rank)`` of the k best passages of each query, or None where the weighted query terms are too
    many to be sent to every task.

    ``groups`` are the caller's departments, ``visible`` a further condition on the columns of ``rows``. Frequencies cover the
    whole index. Ties go to the smaller (document_id, chunk_id).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    asked = weights(spark, folder, queries, fuzzy)
    shipped = _collect_bounded(asked, settings)
    if shipped is None:
        return None
    output = f"query_id {queries.schema['query_id'].dataType.simpleString()}, row bigint, score double"
    score = _scorer(shipped, k, settings, to_arrow_schema(StructType.fromDDL(output)))
    mine = F.col("department_id").isin(groups)
    terms = sorted(set(shipped.column("term").to_pylist()))
    blocks = _of_terms(spark.read.parquet(f"{folder}/blocks").where(mine), asked, terms)
    rows = spark.read.parquet(f"{folder}/rows").where(mine)
    key = ["department_id", "shard"]
    if visible is None:
        best = blocks.groupBy(*key).applyInArrow(lambda table: score(table, None), output)
    else:
        shown = rows.where(visible).select(*key, "row")
        best = blocks.groupBy(*key).cogroup(shown.groupBy(*key)).applyInArrow(lambda table, some: score(table, some.column("row").to_numpy()) if table.num_rows else score(table, None), output)
    # k rows for each query and shard are joined with their keys
    ranked = top_per_key(best.join(rows.select("row", "document_id", "chunk_id"), "row"), ["query_id"], [F.col("score").desc(), F.col("row")], k)
    return cut_lineage(ranked.select("query_id", "document_id", "chunk_id", F.round("score", ROUND).alias("score"), "rank"))
