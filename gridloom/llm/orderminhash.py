"""Order MinHash fingerprints, sensitive to edit distance, in DataFrame expressions alone.

The k-mers of a text are runs of three words, shorter at its end, numbered by occurrence so that repeats count; a text
of one or two words is taken by its characters instead. One hash of (k-mer, occurrence) deals them into bins of two
cells, and each cell keeps its minimal one with its place: bins stand for the many permutations of the textbook form, at
one hash for each k-mer. A bin's tuple is its two minimal k-mers in the order in which the text has them, hashed
together; what a bin lacks is filled from the next ones around, so that the tuples of short texts have an order too.
Texts that share k-mers but have them in another order differ in tuples, so likeness, the share of equal tuples, follows
edit distance and not only the overlap of k-mers.

The k-mers of a document are numbered, dealt and reduced where its text was shuffled to, so they are never shuffled.
Rows of one id are kept together, but for ids with very many rows, which are split by their texts.

Edge cases: a null text counts as empty; texts without words fill no tuple, their fingerprints are equal and their
likeness is 1; a text with one k-mer alone fills all tuples with it; rows with the same id share one next document, the
one whose text has the least hash if several rows have its id; a null id comes after all others; a single document is
its own next; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import HOT_KEYS, cut, partitions

K = 3
TUPLES = 64
PER_TUPLE = 2
SPACE = r"[\x20\x09-\x0D]+"
#: An id with more rows than this, and than one in HOT_KEYS of all rows, is split.
SPLIT_ROWS = 1000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def kmers(text: Column) -> Column:
    """A hash for each k-mer; those at the end of the text are shorter."""

    def of(own: Column) -> Column:
        return F.transform(own, lambda w, i: F.xxhash64(w, *[F.get(own, i + j) for j in range(1, K)]))

    def units(own: Column) -> Column:
        characters = F.filter(F.split(text, ""), lambda c: ~F.rlike(c, F.lit(SPACE)) & (c != ""))
        return F.when(F.size(own).between(1, K - 1), characters).otherwise(own)

    # As the one element of an array the words are split once, not for each k-mer again.
    return F.get(F.transform(F.transform(F.array(words(text)), units), of), 0)


def with_signatures(texts: DataFrame, keys: list[str], numbers: dict[str, Column]) -> DataFrame:
    """(keys, version, numbers, signature) for rows (keys, versions): an array of (version, text).

    Rows with equal keys must be in one partition. A signature is an array of TUPLES numbers, null where no k-mer fell.
    numbers are long columns of the input that are carried along.
    """
    carried = list(numbers)
    held = texts.withColumn("uid", F.monotonically_increasing_id())
    held = held.select(*keys, "uid", *[numbers[c].alias(c) for c in carried], F.explode("versions").alias("v"))
    # Numbers travel as cells below zero, so that all rows are as narrow as a k-mer's.
    cells = F.concat(
        F.array(*[F.struct(F.lit(-1 - i).alias("pos"), F.col(c).alias("kmer")) for i, c in enumerate(carried)]),
        F.transform(kmers(F.col("v.text")), lambda h, i: F.struct(i.alias("pos"), h.alias("kmer"))),
    )
    rows = held.select(*keys, (2 * F.col("uid") + F.col("v.version")).alias("one"), F.inline(cells))
    again = Window.partitionBy(*keys, "one", "kmer").orderBy("pos")
    rows = rows.withColumn("hash", F.when(F.col("pos") < 0, F.col("kmer")).otherwise(F.xxhash64("kmer", F.row_number().over(again))))
    cell = F.when(F.col("pos") < 0, F.col("pos")).otherwise(F.pmod("hash", F.lit(TUPLES * PER_TUPLE)).cast("int"))
    least = rows.groupBy(*keys, "one", cell.alias("cell")).agg(F.min("hash").alias("hash"), F.min_by("pos", "hash").alias("pos"))
    member = F.struct("cell", "pos", "hash")
    whole = least.groupBy(*keys, "one").agg(
        F.sort_array(F.collect_list(F.when(F.col("cell") >= 0, member))).alias("m"),
        F.map_from_entries(F.collect_list(F.when(F.col("cell") < 0, F.struct("cell", "hash")))).alias("numbers"),
    )
    return whole.select(
        *keys,
        F.shiftright("one", 1).alias("uid"),
        (F.col("one") % 2).cast("int").alias("version"),
        *[F.try_element_at("numbers", F.lit(-1 - i)).alias(c) for i, c in enumerate(carried)],
        tuples(F.col("m")).alias("signature"),
    )


def tuples(members: Column) -> Column:
    """The numbers of TUPLES tuples, 32 bits of each hash; members (cell, pos, hash) are those of filled cells in order, one for each."""
    n = F.size(members)

    def next_tuple(state: Column, j: Column) -> Column:
        # Where the first member of this bin, or of the next that has any, stands: two cells are passed for each bin.
        passed = lambda k: F.coalesce((F.get(members, state["at"] + k)["cell"] < PER_TUPLE * j).cast("int"), F.lit(0))
        return F.struct((state["at"] + passed(0) + passed(1)).alias("at"), state["out"].alias("out"), j.alias("j"))

    def written(state: Column) -> Column:
        a, b = F.get(members, state["at"] % n), F.get(members, (state["at"] + 1) % n)
        number = F.when(n == 1, F.xxhash64(a["hash"])).when(a["pos"] <= b["pos"], F.xxhash64(a["hash"], b["hash"])).otherwise(F.xxhash64(b["hash"], a["hash"]))
        return F.struct(state["at"].alias("at"), F.concat(state["out"], F.array(F.shiftright(F.shiftleft(number, 32), 32).cast("int"))).alias("out"), state["j"].alias("j"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("j"))
    bins = F.sequence(F.lit(0), F.lit(TUPLES - 1))
    found = F.aggregate(bins, begin, lambda s, j: F.get(F.transform(F.array(next_tuple(s, j)), written), 0), lambda s: s["out"])
    return F.when(n > 0, found).otherwise(F.array_repeat(F.lit(None).cast("int"), TUPLES))


def fingerprint(signature: Column) -> Column:
    return F.concat_ws("", F.transform(signature, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0"), F.lit("-" * 8))))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples among those that a or b fills; 1 if neither fills any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce((x == y).cast("int"), F.lit(0))))
    filled = F.array_compact(pairs)
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(
        F.aggregate(filled, F.lit(0), lambda s, x: s + x).cast("double") / F.size(filled)
    )


def successors(ids: DataFrame) -> DataFrame:
    """(none, key, next_none, next_key) for distinct rows (none, key): the next one in descending order, around the end."""
    order = F.struct((~F.col("none")).alias("some"), "key")
    dealt = cut(
        ids.withColumn("place", order)
        .repartitionByRange(partitions(ids.sparkSession), F.col("place").desc())
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part").orderBy(F.col("place").desc())
    firsts = dealt.groupBy("part").agg(F.max("place").alias("first"))
    by_part = Window.orderBy("part")
    around = F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # One row for each range partition, a chosen number.
    borders = F.broadcast(firsts.select("part", F.coalesce(F.lead("first").over(by_part), around).alias("beyond")))
    following = dealt.withColumn("following", F.lead("place").over(inside)).join(borders, "part")
    following = following.withColumn("following", F.coalesce("following", "beyond"))
    return following.select("none", "key", (~F.col("following.some")).alias("next_none"), F.col("following.key").alias("next_key"))


def compare_edited(docs: DataFrame, tasks: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs."""
    spark, ids_of, keys = docs.sparkSession, ["none", "key"], ["none", "key", "salt"]
    tasks = tasks or 4 * partitions(spark)
    read = docs.select(
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    third = F.floor(F.length("text") / 3).cast("int")
    ids = cut(read.groupBy(*ids_of).agg(F.max(third).alias("most"), F.count("*").alias("n")))
    many = max(split_rows, (ids.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    # HOT_KEYS ids at most.
    hot = F.broadcast(ids.where(F.col("n") > many).select(*ids_of, F.ceil(F.col("n") / many).cast("int").alias("salts")))
    salts = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1)).alias("salt")
    # Never null, so that both uses of `base` are one exchange.
    salt = F.coalesce(F.pmod(F.xxhash64("text"), F.coalesce("salts", F.lit(1))).cast("int"), F.lit(0))
    base = read.join(hot, ids_of, "left").withColumn("salt", salt).drop("salts").repartition(tasks, *keys)
    after = successors(ids.select(*ids_of)).join(ids.drop("n"), ids_of).join(hot.withColumnRenamed("salts", "own_salts"), ids_of, "left")
    after = cut(after.join(hot.withColumnsRenamed({"none": "next_none", "key": "next_key", "salts": "next_salts"}), ["next_none", "next_key"], "left"))
    # What the next document gives: its text travels to its predecessor no further than that one needs.
    wanted = after.select(
        F.col("next_none").alias("none"), F.col("next_key").alias("key"), salts("next_salts"), F.col("none").alias("to_none"), F.col("key").alias("to_key"),
        "most", "own_salts",
    )
    given = base.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min(F.xxhash64("text")).alias("text_hash"))
    heads = given.join(wanted, keys).select(
        F.col("to_none").alias("none"), F.col("to_key").alias("key"), salts("own_salts"), F.expr("left(text, most)").alias("head"), "text_hash"
    )
    heads = heads.repartition(tasks, *keys).groupBy(*keys).agg(F.min_by("head", "text_hash").alias("head"))
    edited = F.concat(F.expr("left(text, length(text) - floor(length(text) / 3))"), F.expr("left(head, floor(length(text) / 3))"))
    digest = F.sha2("edited", 256)
    both = base.join(heads, keys).withColumn("edited", edited).withColumn("digest", digest).withColumn(
        "versions", F.array(*[F.struct(F.lit(i).alias("version"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))])
    )
    numbers = {"n_chars": F.length("text").cast("long"), "text_hash": F.xxhash64("text")} | {
        f"sha{i}": F.conv(F.substring("digest", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)
    }
    signed = with_signatures(both, keys, numbers)
    of = lambda v, c: F.max_by(c, F.when(F.col("version") == v, F.lit(1)))
    rows = cut(
        signed.groupBy(*keys, "uid").agg(
            F.max("n_chars").alias("n_chars"), F.max("text_hash").alias("text_hash"),
            F.concat(*[F.lpad(F.lower(F.hex(F.max(f"sha{i}"))), 16, "0") for i in range(4)]).alias("edited_sha256"),
            of(0, "signature").alias("own"), of(1, "signature").alias("edited"),
        )
    )
    firsts = rows.groupBy(*ids_of).agg(F.min_by("own", "text_hash").alias("next_own"))
    nexts = after.join(firsts.withColumnsRenamed({"none": "next_none", "key": "next_key"}), ["next_none", "next_key"])
    nexts = nexts.select(*ids_of, salts("own_salts"), "next_own")
    return rows.join(nexts, keys).select(
        F.when(~F.col("none"), F.col("key")).alias("doc_id"), "n_chars", "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
