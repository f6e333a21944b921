"""Threshold-scaled document fingerprints (operator 3), in DataFrame functions only.

The sketch of a text holds every hash of its word shingles below a fixed fraction of
the hash range, and the least hash if there is none such. A sketch grows with its text,
so those of very unequal texts still compare: the share of one sketch's hashes that
the other holds estimates containment. Sketches merge: the union's hashes below the
fraction, or its least one if there is none such, are the sketch of both texts' shingles
together. Shingles across the border of two texts are in none of their sketches.

A shingle is `words` words in a row (of fewer, the whole text is one); words are what
white space separates, in lower case.

Edge cases: null text counts as empty. Texts without words have the empty sketch; the
likeness of two empty sketches is 1, of one and a not empty one 0. Equal texts have
equal sketches. Texts are taken whole, however long. Rows of a null id have no next one;
of several rows of one id the next is that of the next text, then of the next id. Columns
beside the id and the text are ignored by fingerprints() and kept by with_next(), whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, partitions, unused

HASH_BITS = 48


def sketch(text: Column, words: int = 5, one_in: int = 8) -> Column:
    """Sorted distinct hashes, array<bigint>."""
    parts = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - words, F.lit(0))
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(words)]), 64 - HASH_BITS))
        return F.when(F.size(h) > 0, F.array_sort(F.array_distinct(_with(every, lambda a: _retained(a, one_in))))).otherwise(F.array().cast("array<bigint>"))

    return _with(hashes, of)


def _retained(hashes: Column, one_in: int) -> Column:
    """Those below the fraction, or the least of some if none is."""
    low = lambda x: x < (1 << HASH_BITS) // one_in
    return F.when(F.exists(hashes, low), F.filter(hashes, low)).otherwise(F.slice(F.array_sort(hashes), 1, 1))


def _with(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(sketch: Column) -> Column:
    """Hashes in hexadecimal, joined; 12 digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, one_in: int = 8) -> Column:
    """The sketch of two texts' shingles together, from sketches of the same fraction."""
    return F.array_sort(_with(F.array_union(a, b), lambda x: _retained(x, one_in)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, one_in: int = 8) -> DataFrame:
    """(id, text, sketch) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("sketch", sketch(F.col("text"), words, one_in))


def _bucket_heads(ids: DataFrame, shift: int) -> DataFrame:
    """For each non-empty bucket (id >> shift) its least id and the last bucket before
    it, null for the first. Buckets' heads are found level by level, so that no window
    holds more than 2**shift rows or, at the end, a few thousand."""
    heads = ids.groupBy(F.shiftright("id", shift).alias("bucket")).agg(F.min("id").alias("head"))
    heads = materialize(heads, "fp-heads")
    if heads.count() <= 1 << shift:
        w = Window.partitionBy(F.lit(0)).orderBy("bucket")
        return heads.withColumn("before", F.lag("bucket").over(w))
    upper = _bucket_heads(heads.select(F.col("bucket").alias("id")), shift)
    # A head that is first in its own upper bucket follows the last one of the bucket before.
    at = F.shiftright("bucket", shift)
    w = Window.partitionBy("up").orderBy("bucket")
    heads = heads.withColumn("up", at)
    lasts = heads.groupBy("up").agg(F.max("bucket").alias("last")).withColumnRenamed("up", "before_up")
    linked = upper.select(F.col("bucket").alias("up"), F.col("before").alias("before_up")).join(lasts, "before_up", "left").select("up", "last")
    linked = materialize(linked, "fp-linked")
    return heads.withColumn("lag", F.lag("bucket").over(w)).join(linked, "up", "left").select("bucket", "head", F.coalesce("lag", "last").alias("before"))


def with_next(rows: DataFrame, columns: list[str], shift: int = 11, broadcast_rows: int = 100_000, most_rows: int = 50_000) -> DataFrame:
    """rows (with `id`) and, as next_<column>, the columns of the row next by id; after
    the last comes the first. Rows of one id follow each other in the order of columns.
    Null ids have none.

    An id of more than most_rows rows is set apart: its distinct rows (by the columns) are sorted
    by ranges, and only the least of them goes on with the other ids, to be next to the id before
    and to find what follows the id. Of equal rows all but one have their equal next."""
    numbers = materialize(rows.where("id is not null").groupBy("id").count().where(F.col("count") > most_rows).select("id"), "fp-crowded")
    if not numbers.limit(1).count():
        return _with_next(rows, columns, shift, broadcast_rows)
    value, tie, last, span, head, following, of, at = (unused(rows, f"_{n}") for n in ("value", "tie", "last", "span", "head", "following", "of", "at"))
    whole = F.struct(*columns)
    crowd = materialize(rows.join(numbers, "id", "left_semi").withColumns({value: whole, tie: F.monotonically_increasing_id()}), "fp-crowd")
    one = crowd.groupBy("id", value).agg(F.max(tie).alias(last))
    dealt = materialize(one.repartitionByRange(partitions(rows.sparkSession), "id", value).withColumn(span, F.spark_partition_id()), "fp-spans")
    # The first row of each id's next range: a row for each id and range.
    heads = dealt.groupBy("id", span).agg(F.min(value).alias(head)).withColumn(head, F.lead(head).over(Window.partitionBy("id").orderBy(span)))
    ordered = dealt.withColumn(following, F.lead(value).over(Window.partitionBy(span, "id").orderBy(value))).join(heads, ["id", span])
    ordered = materialize(ordered.select("id", value, last, F.coalesce(following, head).alias(following)), "fp-ordered")
    least = ordered.groupBy("id").agg(F.min(value).alias(value)).select("id", F.lit(True).alias(at), *[F.col(value)[c].alias(c) for c in columns])
    others = rows.join(numbers, "id", "left_anti").select("*", F.lit(False).alias(at))
    told = materialize(_with_next(others.unionByName(least, allowMissingColumns=True), columns, shift, broadcast_rows), "fp-told")
    behind = told.where(at).select("id", F.struct(*[F.col(f"next_{c}").alias(c) for c in columns]).alias(head))
    ends = ordered.join(behind, "id").select(F.struct("id", value).alias(of), last, F.coalesce(following, head).alias(following))
    back = crowd.join(ends, F.struct("id", value) == F.col(of))
    then = F.when(F.col(tie) == F.col(last), F.col(following)).otherwise(F.col(value))
    crowded = back.select(*rows.columns, *[then[c].alias(f"next_{c}") for c in columns])
    return told.where(~F.col(at)).drop(at).unionByName(crowded)


def _with_next(rows: DataFrame, columns: list[str], shift: int, broadcast_rows: int) -> DataFrame:
    """with_next() where no id has very many rows.

    Rows are dealt to buckets of 2**shift ids. The rows of a bucket's least id go to the
    bucket before too, where they only serve as the next ones. All moves once."""
    heads = materialize(_bucket_heads(rows.select("id").where("id is not null"), shift), "fp-buckets")
    if not heads.limit(1).count():
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns])
    ends = heads.agg(F.max("bucket").alias("top"), F.min("head").alias("first"), F.count("*").alias("n")).first()
    bucket, extra, at, before, place = (unused(rows, f"_{n}") for n in ("bucket", "extra", "at", "before", "place"))
    marks = heads.select(F.col("head").alias("id"), F.coalesce("before", F.lit(ends["top"])).alias(before))
    marks = F.broadcast(marks) if ends["n"] <= broadcast_rows else marks
    fields = lambda b, e, i: F.struct(b.alias(bucket), F.lit(e).alias(extra), i.alias(at))
    own = fields(F.shiftright("id", shift), False, F.col("id"))
    # After the last id of all comes the first: there it sorts behind every other.
    ahead = fields(F.col(before), True, F.lit((1 << 63) - 1).cast("long"))
    dealt = rows.where("id is not null").join(marks, "id", "left").withColumn(place, F.explode(F.when(F.col(before).isNull(), F.array(own)).otherwise(F.array(own, ahead)))).select("*", f"{place}.*").drop(place, before)
    w = Window.partitionBy(bucket).orderBy(extra, at, *columns)
    ahead_of = {f"next_{c}": F.lead(c).over(w) for c in columns}
    out = dealt.withColumns(ahead_of).where(~F.col(extra)).drop(bucket, extra, at)
    return out.unionByName(rows.where("id is null"), allowMissingColumns=True)


def with_edited(prints: DataFrame, words: int = 5, one_in: int = 8) -> DataFrame:
    """Each text's edited form: its last half (rounded down, in code points) replaced by
    the first as many of the next text, or all of it; and what the sketches tell."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = with_next(prints, ["text", "sketch"]).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), words, one_in))
    none = F.array().cast("array<bigint>")
    return rows.withColumns({"near_edited": likeness(F.col("sketch"), F.col("edited_sketch")), "near_next": likeness(F.col("sketch"), F.coalesce("next_sketch", none))})
