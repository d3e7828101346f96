"""Fingerprints of documents by consistent weighted sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import stored, text_of

# Samples of a fingerprint, and bytes of text in a task.
SAMPLES = 32
TASK_BYTES = 4 << 20

_SPACE = r"[\x20\x09-\x0D]+"
_LOW = (1 << 32) - 1


def _uniform(bits: Column, width: int) -> Column:
    """A number between 0 and 1, both excluded, from ``width`` bits."""
    return (bits + F.lit(0.5)) / F.lit(float(1 << width))


def sample(term: Column, log_weight: Column, j: int) -> Column:
    """What a term of some weight bids in sample ``j``; the lowest bid of a document is its sample.

    With r and c from Gamma(2, 1) and b from the unit interval, all by hashes of the term and ``j``,
    t = floor(log(weight) / r + b), and the term bids c / exp(r * (t - b + 1)). Two documents take the same
    term and t with the chance of their generalised Jaccard similarity. The upper half of the number is the
    logarithm of the bid, in steps of 2**-23, and the lower half a hash of the term and t.
    """
    first, second = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    r = -F.ln(_uniform(F.shiftrightunsigned(first, 32), 32) * _uniform(first.bitwiseAND(F.lit(_LOW)), 32))
    c = -F.ln(
        _uniform(F.shiftrightunsigned(second, 40), 24)
        * _uniform(F.shiftrightunsigned(second, 16).bitwiseAND(F.lit((1 << 24) - 1)), 24)
    )
    b = _uniform(second.bitwiseAND(F.lit((1 << 16) - 1)), 16)
    t = F.floor(log_weight / r + b)
    bid = F.floor((F.ln(c) - r * (t - b + 1) + 128) * float(1 << 23))
    return F.shiftleft(bid, 32).bitwiseOR(F.xxhash64(term, t, F.lit(j)).bitwiseAND(F.lit(_LOW)))


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``ids``, the samples of each text as numbers of 32 bits.

    Terms are the words of the text between ASCII white space, weighed by how often they occur; a text
    without words has the empty one. ``keys`` tell the texts apart. If the rows are dealt out by some of
    the keys already, nothing is shuffled.
    """
    blank = F.col(text).rlike(r"^[\x20\x09-\x0D]*$")
    words = texts.select(*keys, blank.alias("blank"), F.explode(F.split(text, _SPACE)).alias("word"))
    words = words.where((F.col("word") != "") | F.col("blank"))
    terms = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    terms = terms.select(*keys, F.xxhash64("word").alias("term"), F.ln("n").alias("log_n"))
    lowest = [F.min(sample(F.col("term"), F.col("log_n"), j)).alias(f"s{j}") for j in range(samples)]
    ids = F.array(*[F.col(f"s{j}").bitwiseAND(F.lit(_LOW)) for j in range(samples)])
    return terms.groupBy(*keys).agg(*lowest).select(*keys, ids.alias("ids"))


def likeness(a: Column | str, b: Column | str, samples: int = SAMPLES) -> Column:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(samples))


def printed(ids: Column | str) -> Column:
    """A fingerprint as text, 8 hexadecimal digits for each sample."""
    return F.array_join(F.transform(ids, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def next_documents(ids: DataFrame) -> DataFrame:
    """Each ``doc_id, copy`` once, with ``n_chars``, the key of the next one in descending order, and the key and
    length of the one before.

    The order is by ranges: neighbours are found within a range, and the first of each range is the
    neighbour of the last of the one before. After the last comes the first.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("copy")]
    ranged = ids.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "order")
    me = F.struct("doc_id", "copy", "n_chars")
    within = Window.partitionBy("part").orderBy(*order)
    rows = ranged.select("*", F.lead(me).over(within).alias("after"), F.lag(me).over(within).alias("before"))
    ends = ranged.select("part", me.alias("me"), F.row_number().over(within).alias("up"))
    ends = ends.join(ranged.groupBy("part").agg(F.count("*").alias("size")), "part")
    ends = ends.groupBy("part").agg(
        F.max(F.when(F.col("up") == 1, F.col("me"))).alias("first"),
        F.max(F.when(F.col("up") == F.col("size"), F.col("me"))).alias("last"),
    )
    # A row for each range.
    parts, whole = Window.partitionBy().orderBy("part"), Window.partitionBy()
    first_of_all = F.min(F.struct("part", F.col("first").alias("x"))).over(whole)["x"]
    last_of_all = F.max(F.struct("part", F.col("last").alias("x"))).over(whole)["x"]
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(parts), first_of_all).alias("after_part"),
        F.coalesce(F.lag("last").over(parts), last_of_all).alias("before_part"),
    )
    rows = rows.join(ends, "part")
    after, before = F.coalesce("after", "after_part"), F.coalesce("before", "before_part")
    return rows.select(
        "doc_id",
        "copy",
        "n_chars",
        after["doc_id"].alias("next_id"),
        after["copy"].alias("next_copy"),
        before["doc_id"].alias("last_id"),
        before["copy"].alias("last_copy"),
        before["n_chars"].alias("last_n"),
    )


def _third(n: Column) -> Column:
    return F.floor(n / 3).cast("int")


def compare_edited(docs: DataFrame, samples: int = SAMPLES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row of
    ``docs`` (``doc_id, text``).

    A text is edited by putting the beginning of the next document, by descending id, in place of its last
    third. ``near_edited`` and ``near_next`` are the likeness of a fingerprint to that of the edited text and
    to that of the next document.

    A null text is empty. Null ids come last; equal ids are in order of a hash of their texts, and rows that
    are equal in both are one document, whose row is repeated. A single document is next to itself. Texts
    are shuffled once, and beginnings of texts once more. Extra columns are ignored.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rows = rows.withColumns({"copy": F.xxhash64("text"), "n_chars": F.char_length("text").cast("bigint")})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // task_bytes))
    # Ids as text in the keys of joins, so that null ids meet.
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    links = next_documents(rows.select("doc_id", "copy", "n_chars"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    links = stored(
        links.select(
            name("doc_id").alias("key"),
            "copy",
            name("next_id").alias("next_key"),
            "next_copy",
            name("last_id").alias("last_key"),
            "last_copy",
            _third(F.col("last_n")).alias("lent"),
        ),
        "links",
    )
    dealt = rows.select(key.alias("key"), "copy", "text").repartition(tasks, "key", "copy")
    texts = dealt.join(links.repartition(tasks, "key", "copy"), ["key", "copy"])
    lent = texts.select(
        F.col("last_key").alias("key"), F.col("last_copy").alias("copy"), F.expr("substring(text, 1, lent)").alias("head")
    )
    lent = lent.repartition(tasks, "key", "copy").dropDuplicates(["key", "copy"])
    own = texts.dropDuplicates(["key", "copy"]).select("key", "copy", "text", "next_key", "next_copy")
    n = F.char_length("text")
    kept = F.substring("text", F.lit(1), n - _third(n))
    both = own.join(lent, ["key", "copy"]).withColumn("edited", F.concat(kept, "head"))
    versions = F.array(
        F.struct(F.lit(False).alias("edit"), F.col("text").alias("body")),
        F.struct(F.lit(True).alias("edit"), F.col("edited").alias("body")),
    )
    bodies = both.select("key", "copy", F.explode(versions).alias("version")).select("key", "copy", "version.*")
    prints = fingerprints(bodies, ["key", "copy", "edit"], "body", samples)
    prints = prints.groupBy("key", "copy").agg(
        F.max(F.when(~F.col("edit"), F.col("ids"))).alias("ids"), F.max(F.when(F.col("edit"), F.col("ids"))).alias("edited_ids")
    )
    facts = both.select(
        "key", "copy", "next_key", "next_copy", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    )
    whole = stored(facts.join(prints, ["key", "copy"]), "fingerprints")
    following = whole.select(F.col("key").alias("next_key"), F.col("copy").alias("next_copy"), F.col("ids").alias("next_ids"))
    compared = whole.join(following, ["next_key", "next_copy"]).select(
        "key",
        "copy",
        "edited_sha256",
        printed("ids").alias("fingerprint"),
        printed("edited_ids").alias("edited_fingerprint"),
        likeness("ids", "edited_ids", samples).alias("near_edited"),
        likeness("ids", "next_ids", samples).alias("near_next"),
    )
    return rows.select("doc_id", key.alias("key"), "copy", "n_chars").join(compared, ["key", "copy"]).drop("key", "copy")
