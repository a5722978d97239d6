"""Near-duplicate join on word shingles by adaptive multi-match prefixes.

Texts with equal shingle sets are one *class*; all work is on classes. Two classes link
when ``100 * |A & B| >= percent * |A | B|``.

1. Order the shingles of all texts: those that are frequent in the corpus last, the others
   by hash. A set of n whose links need an overlap of ``a`` shares, with any partner, ``l``
   of its first ``n - a + l`` shingles. A class posts such a prefix, ``l`` growing with the
   shingles that it would cost as a candidate, and stays a candidate only if as many of
   them are met in another class's prefix. Frequent shingles count as met and are not posted.
2. *Core*: of the candidates' whole sets only the shingles that two of them have matter. A
   class with fewer than ``a`` such shingles goes. The rest is ordered anew, rarest first,
   by the number of these classes that have a shingle (for a frequent one, the count of 1).
3. *Skeleton*: under a shingle, each class meets only the one of like size whose shingles are
   the commonest; its two likeliest are compared. This is linear in the postings and joins
   up groups of copies, however large.
4. *Rest*: pairs that still lie in different components. Each class chooses ``l`` by estimated
   cost: a longer prefix meets more postings, but at most a part in ``l`` of them are candidates,
   each worth a comparison of sets. A pair of sizes n and m needs an
   overlap ``o``; its first ``l`` shared shingles stand before place ``|set| - o + l`` in
   both sets (``l`` the smaller of the two), so it is compared only if that many of its
   shared shingles do. With ``s`` shingles that others have too, a class of n reaches sizes up to
   ``s * (100 + percent) / percent - n`` at most; postings meet by shingle and band of size, so classes of much
   boilerplate that is too short for a link meet nobody. Under a shingle, members of its largest component are never
   paired with each other. Every pair that can link is either compared or already connected:
   components are exact, with no cap on partners.
5. Components by least label with pointer jumping, in checkpointed rounds; the rest's links
   join components and not classes.

Only steps 1 and 2 read texts, in Arrow batches; all pairs are compared in the JVM, as arrays
of shingle hashes, one row at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import cut, discard, places, settle, stash, trimmed
from lodestone.llm._words import U, Words, chunks, mix

SHINGLE, PERCENT, LAYERS = 5, 75, 4
#: Rows of two or three numbers that may be broadcast once they are counted: some 10 MB.
SMALL = 1 << 18
#: Bands of sizes from a set's own to the largest that it may link to, and postings of a shingle from which they are told apart.
BANDS, CROWD = 4, 32


def shingles(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Of each document: its distinct shingles, ascending; a shorter text is one shingle."""
    start, hashes = words.windows(k)
    first = np.searchsorted(words.doc[start], np.arange(len(words.bounds)))
    sums = None
    out = []
    for d in range(len(words.bounds) - 1):
        lo, hi = words.first[d], words.first[d + 1]
        if hi - lo >= k:
            out.append(np.unique(hashes[first[d] : first[d + 1]]))
        elif hi > lo:
            sums = words.sums() if sums is None else sums
            out.append(words.stretch(sums, np.array([lo]), np.array([hi])))
        else:
            out.append(np.zeros(0, U))
    return out


def class_of(shingles_: np.ndarray, seed: int) -> tuple[int, int]:
    """Two hashes of a set; 0 is kept for the empty one."""
    with np.errstate(over="ignore"):
        m = mix(shingles_ + U(seed))
        return int(mix(np.array([m.sum() + U(len(m))]))[0].view(np.int64)) or 1, int(mix(m + U(0x5851F42D4C957F2D)).sum().view(np.int64))


def _sets(batch_column, k: int):
    for at, _, words in chunks(batch_column, True):
        for i, s in enumerate(shingles(words, k), at):
            yield i, s


def _gather(k: int, seed: int, at_once: int = 2_000_000):
    """Each row's class, and the shingles that a stretch of a partition's classes holds more than once, with counts."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            made = []
            for _, s in _sets(batch.column(3), k):
                c, check = class_of(s, seed) if len(s) else (0, 0)
                made.append((c, check, len(s)))
                if len(s) and c not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                    if size > at_once:
                        yield _counted(held, batch.schema)
                        held, size = [], 0
            c, check, n = zip(*made, strict=True) if made else ((), (), ())
            none = pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(c, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), none, none], names=GATHERED)
        if held:
            yield _counted(held, batch.schema)

    return trimmed(run)


GATHERED = ["key", "place", "place2", "class", "check", "n", "token", "times"]


def _counted(held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    value, count = np.unique(np.concatenate(held), return_counts=True)
    more = count > 1
    rows = int(more.sum())
    none = [pa.nulls(rows, t) for t in (*(schema.field(i).type for i in range(3)), pa.int64(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(value[more].view(np.int64)), pa.array(count[more].astype(np.int64))], names=GATHERED)


def _frequent(counts: DataFrame, least: int = 64, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Shingles to order last, ascending, and their counts: the ``most`` most frequent of those counted at least ``least`` times.

    Any set gives exact results, as the order only has to be the same for all; this one
    keeps passages that many texts share out of the prefixes and out of the shuffles. Counts
    are over all texts, but leave out a shingle that stands once in a stretch of two million."""
    total = counts.groupBy("token").agg(F.sum("times").alias("n")).filter(F.col("n") >= least)
    found = total.orderBy(F.desc("n"), "token").limit(most).collect()
    tokens = np.array([r["token"] for r in found], np.int64).view(U)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in found], np.int64)[order]


def _split(s: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of a set are frequent, and where these stand among the frequent ones."""
    at = np.minimum(np.searchsorted(late, s), max(0, len(late) - 1))
    return (late[at] == s if len(late) else np.zeros(len(s), bool)), at


def layer(n, percent: int):
    """Shingles that a set of n asks for beyond the first: the more shingles a candidate costs, the longer its prefix."""
    return np.minimum(np.maximum(1, n // 16), -(-percent * n // 100))


def _postings(k: int, seed: int, percent: int, frequent):
    """Prefix shingles of each class. ``need``: how many of the asking ones (need > 0) must be met elsewhere; -1 marks a
    class that frequent shingles alone make a candidate."""

    def run(batches):
        late, _ = frequent.value
        seen: set[int] = set()
        tokens, classes, needs, size = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(needs))], names=["token", "class", "need"])

        for batch in batches:
            for _, s in _sets(batch.column(0), k):
                if not len(s):
                    continue
                c, _ = class_of(s, seed)
                if c in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                n = len(s)
                overlap = -(-percent * n // 100)
                # The smallest partner has ``overlap`` shingles and so posts layer(overlap) ones more than it must.
                asked = int(layer(overlap, percent))
                give, ask = n - overlap + int(layer(n, percent)), n - overlap + asked
                cold = s[~_split(s, late)[0]]
                need = asked - max(0, ask - len(cold))
                first = cold[:give]
                wants = np.zeros(len(first), np.int32)
                if need > 0:
                    wants[:ask] = need
                else:
                    first, wants = np.append(first, U(c & 0xFFFFFFFFFFFFFFFF)), np.append(wants, np.int32(-1))
                tokens.append(first), classes.append(np.full(len(first), c, np.int64)), needs.append(wants)
                size += len(first)
                if size > 200_000:
                    yield flush()
                    tokens, classes, needs, size = [], [], [], 0
        if size:
            yield flush()

    return trimmed(run)


def _whole(k: int, seed: int, frequent):
    """(deal, class, token, known): all shingles of each text. A frequent one has a known count and is dealt by class, the others by themselves."""

    def run(batches):
        late, counts = frequent.value
        for batch in batches:
            for at, _, words in chunks(batch.column(0), True):
                made = [(class_of(s, seed)[0], s) for s in shingles(words, k) if len(s)]
                if made:
                    tokens = np.concatenate([s for _, s in made])
                    classes = np.repeat(np.array([c for c, _ in made], np.int64), [len(s) for _, s in made])
                    hot, place = _split(tokens, late)
                    known = np.zeros(len(tokens), np.int64)
                    known[hot] = counts[place[hot]]
                    tokens = tokens.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(hot, classes, tokens)), pa.array(classes), pa.array(tokens), pa.array(known)], names=["deal", "class", "token", "known"])

    return trimmed(run)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """A table of two or three numbers a row to be joined with: broadcast if it has been counted to have ``SMALL`` rows at most, else left to a merge join."""
    return F.broadcast(df) if rows <= SMALL else df


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link.

    Least labels spread over the links and along the labels themselves (pointer jumping),
    so chains shorten by half each round. Every round is checkpointed. ``rows`` of the result is their number."""
    both = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")))
    rows = labels.count()
    while True:
        near = both.join(narrow(labels.select(F.col("x").alias("y"), "l"), rows), "y").groupBy("x").agg(F.min("l").alias("m"))
        spread = near.join(narrow(labels, rows), "x").select("x", "l", F.least("l", "m").alias("m"))
        jumped = spread.join(narrow(labels.select(F.col("x").alias("m"), F.col("l").alias("j")), rows), "m", "left")
        new = cut(jumped.select("x", F.least("m", "j").alias("l"), (F.least("m", "j") < F.col("l")).alias("moved")))
        if new.filter("moved").isEmpty():
            found = new.select(F.col("x").alias("node"), F.col("l").alias("component"))
            found.rows = rows
            return found
        labels = new.drop("moved")


def _candidates(classes: DataFrame, posted: DataFrame) -> DataFrame:
    """(place, place2) of one row of each class that met enough of its prefix elsewhere."""
    by_token = Window.partitionBy("token")  # frequent shingles are not posted, so no shingle has very many rows
    met = posted.withColumn("first", F.min("class").over(by_token)).withColumn("last", F.max("class").over(by_token))
    met = met.filter("(first <> last and need > 0) or need = -1").dropDuplicates(["token", "class"])  # by token already: no further shuffle
    wanted = met.groupBy("class").agg(F.count("*").alias("met"), F.max("need").alias("need"), F.min("need").alias("sure")).filter("sure = -1 or met >= need").select("class")
    return stash(classes.join(wanted, "class", "left_semi").select(F.col("one.place").alias("place"), F.col("one.place2").alias("place2")), "candidates")


def _core(source: DataFrame, classes: DataFrame, chosen: DataFrame, frequent, k: int, seed: int, percent: int) -> DataFrame:
    """(class, n, sh, least, ids, weight) of the classes that may link: ids are the shingles that another such class has too, rarest first."""
    # A merge join at every size, so that the plan is the same for large tables; the texts' shuffle is over before their shingles' begins.
    texts = stash(source.join(chosen.hint("merge"), ["place", "place2"], "left_semi").dropDuplicates(["place", "place2"]).select("text"), "texts")
    settle(source.sparkSession)
    tokens = texts.mapInArrow(_whole(k, seed, frequent), "deal long, class long, token long, known long")
    counted = tokens.withColumn("m", F.count("*").over(Window.partitionBy("deal"))).filter("known > 0 or m > 1")
    counted = counted.select("class", F.struct(F.when(F.col("known") > 0, F.col("known")).otherwise(F.col("m")).alias("df"), "token").alias("t"))
    grouped = counted.groupBy("class").agg(F.sum("t.df").alias("total"), F.sort_array(F.collect_list("t")).alias("s")).withColumn("sh", F.size("s")).join(classes.select("class", "n"), "class")
    overlap = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    grouped = grouped.withColumn("least", overlap).filter(F.col("sh") >= F.col("least"))
    core = stash(grouped.select("class", "n", "sh", "least", F.col("s.token").alias("ids"), (F.col("total") / F.col("n")).alias("weight")), "core")
    discard(texts)
    return core


def _links(core: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Links that make the skeleton's components, and links (of components, ca and cb) that join these."""
    prefix = F.slice("ids", 1, F.col("sh") - F.col("least") + F.least("least", F.lit(LAYERS)))
    # With sh shingles to share, a class links to sizes up to ``hi`` at most: beyond it, more shingles are needed than it has.
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("sh") * ((100 + percent) / percent) + 1e-6) - F.col("n"))
    ranged = core.withColumns({"lo": low, "hi": high}).filter("lo <= hi")
    postings = stash(ranged.select("class", "n", "sh", "lo", "hi", "weight", F.posexplode(prefix).alias("pos", "token")), "postings")
    sizes = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    needed = lambda x, y: F.floor((F.lit(percent) * (x + y) + (99 + percent)) / (100 + percent))

    def check(pairs: DataFrame) -> DataFrame:
        one, two = (core.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
        both = pairs.join(one, "a").join(two, "b").withColumn("same", F.size(F.array_intersect("ids_a", "ids_b")))
        return stash(both.filter(F.col("same") >= needed(F.col("na"), F.col("nb"))).select(*pairs.columns), "links")

    # The skeleton: under each shingle, the classes of like size meet the one whose shingles are the commonest.
    band = F.floor(F.log("n") / math.log(100 / min(percent, 99)))
    hubs = postings.groupBy("token", band.alias("band")).agg(F.max(F.struct("weight", F.col("class").alias("hub"), F.col("n").alias("m"), F.col("sh").alias("mh"))).alias("h"))
    offers = postings.select("token", "class", "n", "sh", F.explode(F.array(band, band + 1)).alias("band")).join(hubs, ["token", "band"])
    offers = offers.filter((F.col("h.hub") != F.col("class")) & sizes(F.col("n"), F.col("h.m")) & (F.least("sh", "h.mh") >= needed(F.col("n"), F.col("h.m"))))
    voted = offers.groupBy("class", F.col("h.hub").alias("hub")).agg(F.count("*").alias("votes"))
    best = voted.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("votes"), "hub"))).filter("nth <= 2")
    links = check(best.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct())
    found = components(links)
    # The rest: pairs in different components, under shingles whose classes are in several.
    placed = postings.join(narrow(found.withColumnRenamed("node", "class"), found.rows), "class", "left").withColumn("component", F.coalesce("component", "class")).drop("weight")
    split = placed.groupBy("token", "component").agg(F.count("*").alias("m")).groupBy("token").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("major")).filter("parts > 1")
    open_ = stash(placed.join(split.select("token", "all", "major"), "token"), "open")
    discard(postings)
    # The prefix that l asks for meets so many classes of other components, and a part in l of them at most are candidates, each worth a comparison of sets.
    others = F.when(F.col("component") == F.col("major.component"), F.col("all") - F.col("major.m")).otherwise(F.col("all") - 1)
    bar = F.greatest(F.lit(0), F.col("sh") - needed(F.col("n"), F.col("n")))
    costs = [F.sum(F.when(F.col("pos") < bar + at, others).otherwise(0)) * (1 + F.max("sh") / (4.0 * at)) for at in range(1, LAYERS + 1)]
    chosen = open_.groupBy("class").agg(F.array(*costs).alias("costs")).select("class", F.array_position("costs", F.array_min("costs")).cast("int").alias("ell"))
    open_ = open_.join(chosen, "class").select("token", "class", "n", "sh", "lo", "hi", "ell", "pos", "component", F.col("major.component").alias("major"), (F.col("all") > CROWD).alias("crowd"))
    side = lambda c: (F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sh").alias(f"s{c}"), F.col("ell").alias(f"l{c}"), F.col("pos").alias(f"p{c}"), F.col("component").alias(f"c{c}"))
    # Under a shingle that many classes have, a class meets only those of sizes that it can still reach.
    place = lambda size: F.floor(F.log(size) * (BANDS / math.log(100 / min(percent, 99)))).cast("int")
    reached = F.when(F.col("crowd"), F.sequence(place(F.col("lo")), place(F.col("hi")))).otherwise(F.array(F.lit(-1)))
    one = open_.filter("component <> major").select("token", *side("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(reached).alias("reach"))
    two = open_.select("token", *side("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), (F.col("component") == F.col("major")).alias("big"), F.when(F.col("crowd"), place(F.col("n"))).otherwise(-1).alias("reach"))
    o = needed(F.col("na"), F.col("nb"))
    most = F.least("la", "lb", o)
    may = (F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b"))) & sizes(F.col("na"), F.col("nb")) & (F.least("sa", "sb") >= o) & (F.col("pa") < F.col("sa") - o + most) & (F.col("pb") < F.col("sb") - o + most)
    mutual = F.col("nb").between(F.col("lo_a"), F.col("hi_a")) & F.col("na").between(F.col("lo_b"), F.col("hi_b"))
    met = one.join(two, ["token", "reach"]).filter(mutual & may)
    first = F.col("a") < F.col("b")  # under different shingles a pair may stand either way round
    turned = lambda x, y: (F.when(first, F.col(x)).otherwise(F.col(y)).alias(x), F.when(first, F.col(y)).otherwise(F.col(x)).alias(y))
    pairs = met.select(*turned("a", "b"), *turned("ca", "cb"), most.alias("l")).groupBy("a", "b", "ca", "cb", "l").agg(F.count("*").alias("shared")).filter("shared >= l")
    more = check(pairs.select("a", "b", "ca", "cb"))
    return found, None if more.isEmpty() else components(more.select("ca", "cb").distinct(), "ca", "cb")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, place, place2, group, n_shingles, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest key reachable by links, itself included; ``group`` names
    the component even where keys are null or repeat, and is null for a text without words.
    ``place`` and ``place2`` are hashes of the row's key and text. The key may be of any type
    that Spark orders. A null or blank text has no shingle and no link; its component is its
    own key. Rows with a null key link like others, but name a component only if nothing else
    can. Columns of other names are not read. An empty table gives no rows."""
    spark = docs.sparkSession
    place, place2 = places(key, text)
    source = docs.select(F.col(key).alias("key"), place.alias("place"), place2.alias("place2"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    seed = 0
    while True:
        gathered = stash(source.mapInArrow(_gather(k, seed), f"key {kind}, place long, place2 long, class long, check long, n long, token long, times long"), "gathered")
        members = gathered.filter("token is null").select("key", "place", "place2", "class", "check", "n")
        classes = members.filter("n > 0").groupBy("class").agg(F.min(F.struct("place", "place2")).alias("one"), F.min("key").alias("least"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n"), F.max("n").alias("n1"))
        classes = stash(classes, "classes")
        if classes.filter("c0 <> c1 or n <> n1").isEmpty():
            break
        seed += 1  # two sets share a 64-bit hash: other hashes
    frequent = spark.sparkContext.broadcast(_frequent(gathered.filter("token is not null").select("token", "times")))
    posted = source.select("text").mapInArrow(_postings(k, seed, percent, frequent), "token long, class long, need int")
    chosen = _candidates(classes, posted)
    settle(spark)
    core = _core(source, classes, chosen, frequent, k, seed, percent)
    frequent.destroy()
    discard(chosen)
    settle(spark)
    found, moved = _links(core, percent)
    discard(core)
    named = classes.select("class", "least").join(narrow(found.withColumnRenamed("node", "class"), found.rows), "class", "left").withColumn("component", F.coalesce("component", "class"))
    if moved is not None:
        named = named.join(narrow(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), moved.rows), "component", "left").withColumn("component", F.coalesce("to", "component"))
    named = cut(named.select("class", "least", "component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "component").select("class", "component", "smallest")
    columns = [F.col("key").alias(key), "place", "place2"]
    linked = members.filter("n > 0").join(named, "class").select(*columns, F.col("component").alias("group"), F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"))
    blank = members.filter("n = 0").select(*columns, F.lit(None).cast("long").alias("group"), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return linked.unionByName(blank)
