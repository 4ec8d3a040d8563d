"""Operator 9: near-duplicate detection by SimHash and an LSH forest, with DataFrame functions only.

1. Texts. Documents with equal text are one class from the start, so a group of exact copies is one row from here on.
2. Fingerprints. A text's features are its distinct words and its distinct pairs of neighbouring words in lower case, whatever its
   length; numbers and short words count, and a letter of a script without blanks is a word. A 192-bit SimHash is
   counted bit by bit in one aggregation that combines on the map side. Texts with equal fingerprints are linked and stand in the forest as one.
3. Forest. Each tree reads DEPTH bits in a random order of its own. Texts that share a prefix of a tree are
   candidates. The forest has as many trees as a pair at the accepted distance needs to share a prefix with probability RECALL. Both are the same for
   every table, so whether two texts are linked depends on these two texts alone.
4. Verification. A candidate pair is a link if all 192 bits together differ in at most MOST_BITS places; checked inside the join, before any pair is written.
5. Density. Under a prefix with more than CROWD texts the same classes are found by fewer comparisons, and no link that joins two classes is left out.
   LEADERS texts, drawn by hash, are compared with all of the prefix's texts; what is near a leader is linked to it, so a group of near copies costs linear work.
   Between a leader's texts and all others of other classes every pair is compared that the triangle inequality leaves, and the texts that no leader is near
   go through this again; when that takes few away, all their pairs are compared, in tiles over many tasks.
6. Classes. Links and shared texts are joined into connected components; a class's id is its smallest doc_id.

Results: one row a document with class_id, n_copies (documents with this very text, itself included) and kept (it is its class's one representative).

Defined results: null texts are classes of their own; empty texts are equal texts; texts without a word are linked to equal
texts only; texts of any length count whole. Links are between texts: rows that repeat a doc_id with unrelated texts stand in unrelated classes (which then may share
their smallest doc_id as class_id), and kept holds for one row of each; of rows alike in doc_id and text one is kept. Rows without doc_id have no class and are
kept; an empty table gives an empty result; added columns replace columns of their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut, table

BITS, WORDS = 192, 3
#: Links: at most so many differing bits; 36 of 192 is a cosine of 0.83, for sets a Jaccard similarity of 0.71. Texts of similarity 0.8 differ in 29 bits on average.
MOST_BITS = 36
#: A pair that differs in MOST_BITS places, the farthest that is accepted, is met with this probability; nearer ones more surely.
RECALL = 0.95
#: A forest has so many trees at least; short prefixes could do with fewer.
LEAST_TREES = 6
#: Bits of a prefix, for tables of any size. Bits of unlike texts of the check's tables collide as 0.97 fair ones do (47,257 texts), so two such texts share a prefix once in about 47,000 pairs.
DEPTH = 16
#: For depth_for: texts that a text shares a prefix with, on average, and depths that are tried for it.
CROWDING, STEPS = 512, 16
#: Texts under a prefix beyond which it is searched through LEADERS leaders; DEEPER is a depth the tests look at.
CROWD, LEADERS, DEEPER = 16 * CROWDING, 16, 6
#: A prefix is crowded if more texts of a sample are under it, so large that at CROWD it has this many; what isn't grouped goes round again if at most FEWER of it is left.
SAMPLED, FEWER = 64, 0.75
#: Crowded prefixes up to this many are sent to all tasks, more are joined.
BROADCAST = 50_000
#: A crowded prefix's texts meet its leaders, and each other, in so many parts.
PARTS = 16
SEED = 20

#: Scripts without blanks: Thai and Lao, Burmese, Khmer, kana, Han.
_DENSE = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{323AF}"
WORD = rf"[\p{{L}}\p{{N}}\p{{M}}&&[^{_DENSE}]]+|[{_DENSE}&&[\p{{L}}\p{{N}}]]"


def shared(depth: int, differ: int = MOST_BITS) -> float:
    """Chance that fingerprints that differ in so many places agree in ``depth`` bits drawn at random."""
    return math.prod((BITS - differ - k) / (BITS - k) for k in range(depth))


def trees_needed(depth: int, differ: int = MOST_BITS, recall: float = RECALL) -> int:
    return max(LEAST_TREES, math.ceil(math.log(1 - recall) / math.log1p(-shared(depth, differ))))


def depth_for(texts: DataFrame, count: int, crowding: int = CROWDING) -> int:
    """For choosing DEPTH, no query asks for it: the shortest prefix, of an order of its own, under which a text has ``crowding`` others at most on average. Counted at each depth from log2 of the number of texts, less those bits, upwards: bits of alike texts tell less apart than their number says."""
    least = max(1, math.ceil(math.log2(max(2, count))) - math.ceil(math.log2(crowding)))
    ladder = list(range(least, min(least + STEPS, 60)))
    whole = F.expr(_prefix(_orders(-1, 1, ladder[-1])))[0]
    cut_at = [F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned(whole, ladder[-1] - d).alias("prefix")) for d in ladder]
    sizes = texts.select(F.explode(F.array(*cut_at)).alias("p")).groupBy("p.depth", "p.prefix").agg(F.count("*").cast("double").alias("m"))
    mean = {r.depth: r.squares / count for r in sizes.groupBy("depth").agg(F.sum(F.col("m") * F.col("m")).alias("squares")).collect()}
    return next((d for d in ladder if mean.get(d, 0) <= crowding), ladder[-1])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each distinct text: its digest and the words s0..s2 of its SimHash (null if it has no word)."""
    rows = df.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")).filter("text IS NOT NULL")
    # bound in a lambda, so the words are taken from the text once, not once a pair
    found = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    features = F.transform(F.array(found), lambda w: F.array_distinct(F.concat(w, F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.xxhash64(w[i], x)))))[0]
    rows = rows.select("row", digest_of("text").alias("digest"), features.alias("f"))  # below the generator, so once a row
    tokens = rows.select("row", "digest", F.explode_outer("f").alias("h0"))
    tokens = tokens.select("row", "digest", F.col("h0").isNotNull().cast("long").alias("one"), *[(F.coalesce("h0", F.lit(0)) if k == 0 else F.xxhash64("h0", F.lit(k))).alias(f"h{k}") for k in range(WORDS)])
    # two counters of 32 bits to a long: bits b and b + 32; they count one row each, so they can't overflow however many rows are alike
    sums = [F.sum(F.shiftright(f"h{k}", b).bitwiseAND(F.lit(0x0000000100000001))).alias(f"c{k}_{b}") for k in range(WORDS) for b in range(32)]
    counted = tokens.groupBy("row", "digest").agg(F.sum("one").alias("n"), *sums)
    low_half, high_half = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftright(c, 32))
    out = []
    for k in range(WORDS):
        bit = lambda c, b: F.when(2 * c > F.col("n"), F.lit(_signed(1 << b))).otherwise(F.lit(0).cast("long"))
        parts = [bit(half(f"c{k}_{b}"), b + add) for b in range(32) for half, add in ((low_half, 0), (high_half, 32))]
        while len(parts) > 1:  # a balanced tree, as a long chain nests too deep
            parts = [x.bitwiseOR(y) for x, y in zip(parts[::2], parts[1::2])]
        out.append(F.when(F.col("n") > 0, parts[0]).alias(f"s{k}"))
    return counted.select("digest", *out).groupBy("digest").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(WORDS)])


def digest_of(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _prefix(order: list[list[int]]) -> str:
    """SQL for the bits of s0..s2 in each of the orders, as an array. The plan holds the orders as one literal, so it doesn't grow with them."""
    bits = ", ".join(f"array({', '.join(map(str, own))})" for own in order)
    words = ", ".join(f"s{k}" for k in range(WORDS))
    return f"transform(array({bits}), own -> aggregate(own, 0L, (p, b) -> shiftleft(p, 1) | (shiftright(array({words})[CAST(b div 64 AS INT)], b % 64) & 1L)))"


def _orders(level: int, trees: int, depth: int) -> list[list[int]]:
    draw = random.Random(f"{SEED} {level}")
    return [draw.sample(range(BITS), depth) for _ in range(trees)]


_PRINT = ("id", *[f"s{k}" for k in range(WORDS)])


def _differ(a: str, b: str):
    """In how many bits the prints with these names differ."""
    differ = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(WORDS)]
    return sum(differ[1:], differ[0])


def _near(a: str, b: str, most_bits: int):
    """Condition that the prints with these names differ in at most so many bits."""
    return _differ(a, b) <= most_bits


def _pairs(rows: DataFrame, most_bits: int) -> DataFrame:
    """Links among the texts of each node."""
    a, b = (rows.select(F.col("node").alias(f"node_{x}"), F.col("id").alias(f"id_{x}"), *[F.col(f"s{k}").alias(f"{x}{k}") for k in range(WORDS)]) for x in "ab")
    met = a.join(b, (F.col("node_a") == F.col("node_b")) & (F.col("id_a") < F.col("id_b")) & _near("a", "b", most_bits))
    return met.select("id_a", "id_b")


def _leaders(rows: DataFrame, leaders: int) -> DataFrame:
    """Leaders of each node: node, leader and its words l0..l2."""
    drawn = rows.groupBy("node", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(leaders)).alias("seat")).agg(F.min(F.struct(*_PRINT)).alias("l"))
    return drawn.select("node", F.col("l.id").alias("leader"), *[F.col(f"l.s{k}").alias(f"l{k}") for k in range(WORDS)])


def _part():
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")


def _parts():
    return F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))


def _classed(rows: DataFrame, edges: DataFrame, *ids: str) -> DataFrame:
    """Adds to each of the ids its class in edges, as class_ and the id's name."""
    classes = cut(components(edges))
    for i in ids:
        rows = rows.join(classes.select(F.col("id").alias(i), F.col("class").alias(f"class_{i}")), i, "left").withColumn(f"class_{i}", F.coalesce(f"class_{i}", i))
    return rows


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def _across(rows: DataFrame, met: DataFrame, mine: DataFrame, edges: DataFrame, most_bits: int) -> DataFrame:
    """Links between what a leader is near to and the node's other texts, one for each text and leader. By the triangle inequality they are of texts that are no farther from the leader than its farthest text and most_bits together; those in the leader's class already are left out."""
    far = mine.groupBy("node", "leader").agg(F.max("d").alias("radius"))
    own = mine.select("node", "id", F.col("leader").alias("own"))
    asked = met.filter(F.col("d") > most_bits).join(far, ["node", "leader"]).filter(F.col("d") <= F.col("radius") + most_bits).join(own, ["node", "id"], "left").filter("own IS NULL OR own < leader")
    asked = _classed(asked.select("node", "id", "leader"), edges, "id", "leader").filter("class_id != class_leader")
    asked = asked.select("node", "id", "leader").join(rows, ["node", "id"]).select("node", "leader", F.col("id").alias("other"), *[F.col(f"s{k}").alias(f"l{k}") for k in range(WORDS)], _parts().alias("part"))
    held = mine.select("node", "id", "leader").join(rows, ["node", "id"]).withColumn("part", _part())
    near = held.join(asked, ["node", "leader", "part"]).filter(_near("s", "l", most_bits))
    return near.groupBy("node", "leader", "other").agg(F.min("id").alias("id")).select(*_ordered("id", "other"))


def _tiled(rows: DataFrame, edges: DataFrame, most_bits: int) -> DataFrame:
    """Links between texts of different classes within each node, all pairs in PARTS x PARTS tiles."""
    rows = cut(_classed(rows, edges, "id"))
    cols = lambda x: ["node", F.col("id").alias(f"id_{x}"), F.col("class_id").alias(f"class_{x}"), *[F.col(f"s{k}").alias(f"{x}{k}") for k in range(WORDS)]]
    a = rows.select(*cols("a"), _part().alias("part_a"), _parts().alias("part_b"))
    b = rows.select(*cols("b"), _parts().alias("part_a"), _part().alias("part_b"))
    met = a.join(b, ["node", "part_a", "part_b"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("class_a") != F.col("class_b")) & _near("a", "b", most_bits))
    return met.select("id_a", "id_b")


def _crowded(rows: DataFrame, found: DataFrame, most_bits: int, crowd: int, leaders: int) -> DataFrame:
    """found, and links of crowded nodes' rows so many that together they have the components of all links there."""
    n = rows.count()
    while n:
        lead = _leaders(rows, leaders).withColumn("part", _parts())
        # two texts near each other, one of them near a leader: the other is within twice most_bits of it
        met = rows.withColumn("part", _part()).join(lead, ["node", "part"]).withColumn("d", _differ("s", "l")).filter(F.col("d") <= 2 * most_bits)
        met = cut(met.select("node", "id", "leader", "d"))
        found = cut(found.unionByName(met.filter((F.col("d") <= most_bits) & (F.col("id") != F.col("leader"))).select(*_ordered("id", "leader"))).distinct())
        mine = cut(met.filter(F.col("d") <= most_bits).groupBy("node", "id").agg(F.min(F.struct("d", "leader")).alias("m")).select("node", "id", "m.leader", "m.d"))
        found = cut(found.unionByName(_across(rows, met, mine, found, most_bits)).distinct())
        rows = cut(rows.join(mine.select("node", "id"), ["node", "id"], "left_anti"))
        left = rows.groupBy("node").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if left["all"] and (left["most"] <= crowd or left["all"] > FEWER * n):
            return found.unionByName(_tiled(rows, found, most_bits)).distinct()
        n = left["all"]
    return found


def _nodes(texts: DataFrame, trees: int, depth: int) -> DataFrame:
    """A row for each text and tree, with the node it stands in."""
    rows = texts.select(*_PRINT, F.posexplode(F.expr(_prefix(_orders(0, trees, depth)))).alias("tree", "prefix"))
    return rows.select((F.col("prefix") * trees + F.col("tree")).alias("node"), *_PRINT)


def links(texts: DataFrame, most_bits: int = MOST_BITS, crowd: int = CROWD, leaders: int = LEADERS, depth: int = DEPTH) -> DataFrame:
    """Distinct links id_a < id_b of texts (id, s0..s2), whose fingerprints are distinct: all pairs that share a prefix of a tree and differ in at most most_bits places, whatever other texts there are. Under crowded prefixes only as many of them as join what all of them join."""
    trees = trees_needed(depth, most_bits)
    rows = _nodes(texts, trees, depth)
    # which way a node goes doesn't change what is joined, so a share of the texts is enough to tell
    every = max(1, crowd // SAMPLED)
    some = _nodes(texts.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(every)) == 0), trees, depth)
    crowded = cut(some.groupBy("node").count().filter(F.col("count") > crowd // every).select("node"))
    n = crowded.count()
    if not n:
        return _pairs(rows, most_bits).distinct()
    if n <= BROADCAST:
        crowded = F.broadcast(crowded)
    found = cut(_pairs(rows.join(crowded, "node", "left_anti"), most_bits).distinct())
    return _crowded(cut(rows.join(crowded, "node", "left_semi").select("node", *_PRINT)), found, most_bits, crowd, leaders)


def components(edges: DataFrame) -> DataFrame:
    """id and class of every id in edges (id_a, id_b): its component's smallest id. Alternates large-star and small-star steps until nothing changes, a logarithmic number of rounds."""
    e = cut(edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.filter("u != v").distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id, n_copies and kept, a row for each row of df."""
    return _judged(df, doc_id, text, most_bits, crowd).drop("digest")


def _judged(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, crowd: int = CROWD) -> DataFrame:
    """The same with the text's digest."""
    words = [f"s{k}" for k in range(WORDS)]
    of = cut(df.select(F.col(doc_id).cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("row")))
    # a text's first row is the one of its smallest doc_id
    firsts = of.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first"), F.count("*").alias("n_copies"))
    texts = cut(fingerprints(df, doc_id, text).join(firsts, "digest").select("digest", *words, "n_copies", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")))
    # rows are unique, so a row's number is its text's in the graph, whatever the doc_ids
    prints = texts.filter("s0 IS NOT NULL AND row IS NOT NULL").groupBy(*words).agg(F.min("row").alias("id"))
    # narrow rows that the forest makes many of: few partitions would leave most cores idle
    prints = cut(prints.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = cut(links(prints.select("id", *words), most_bits, crowd))
    classes = components(found)
    at = prints.join(classes, "id", "left").select(*words, F.coalesce("class", "id").alias("class"))
    by_text = texts.filter("row IS NOT NULL").join(at, words, "left").select("digest", "doc_id", "row", "n_copies", F.coalesce("class", "row").alias("class"))
    heads = by_text.groupBy("class").agg(F.min(F.struct("doc_id", "digest", "row")).alias("head"))
    by_text = by_text.join(heads, "class").select("digest", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head"), "n_copies")
    without_ids = texts.filter("row IS NULL").select("digest", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("head"), "n_copies")
    out = of.join(by_text.unionByName(without_ids), "digest", "left")
    has = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    return out.select("doc_id", F.when(has, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (~has | (F.col("row") == F.col("head"))).alias("kept"), "digest")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the representative of each class, a row for each text of its kind; documents without id or text stay. Rows alike in doc_id and text leave one, the least of them as JSON, so reruns agree."""
    gone = _judged(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("doc_id IS NOT NULL AND digest IS NOT NULL AND (NOT kept OR n > 1)")
    gone = cut(gone.select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest"), "kept"))
    rows = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), "__digest": digest_of("text")})
    left = rows.join(gone, ["__doc_id", "__digest"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    alike = rows.join(gone.filter("kept").drop("kept"), ["__doc_id", "__digest"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = alike.groupBy("__doc_id", "__digest").agg(F.min_by(whole, F.to_json(whole)).alias("__one"))
    return left.unionByName(one.select(*[F.col(f"__one.`{c}`").alias(c) for c in docs.columns]))
