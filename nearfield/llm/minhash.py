"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass makes each document's set of word shingles and its signature of
   `coordinates` minima. Documents with equal sets form a class; only one row
   per class goes on.
2. Classes are posted under each (coordinate, value). A pair that matches in at
   least `least` coordinates shares one of the coordinates - least + 1 rarest
   posts of both (prefix filter, one global order), so frequent posts are
   skipped, unless a class has hardly any others; a class with fewer than
   `least` shared posts has no pair.
3. Each list is joined to its smallest member, which is linear in the posts
   whatever a list's length. The collisions of these pairs are counted over all
   coordinates; pairs of `least` or more are confirmed on the full sets, and
   links are contracted to components.
4. Members of all lists with the same smallest member are a group, and a
   member's home is the largest of its groups. Pairs with the same home meet
   there; in the other groups only pairs of different homes do. Groups that
   still hold several components are counted: pairs of different components
   that collide in the prefix are merged over the other coordinates, those
   that can't reach `least` are skipped. Only members of a pair at or over
   `least` go on with their texts, where such pairs are confirmed on the full
   sets, and only the links that join components leave the task. Groups over
   `block` members or `block_shingles` are split into blocks and each pair of
   blocks is a task of its own. Nothing is capped.

With J = 0.75, 64 coordinates and least = 30 the chance to miss a pair is below
one in a million; what is kept is exact, as links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, hash_words, id_text, materialize, mix, raw_bytes
from .components import connected_components

MULTIPLIER = 0x9E3779B97F4A7C15
#: Tasks that a hot group's rows are dealt to while its size is joined to them.
SALTS = 16


def shingles(raw: bytes, n: int = 5) -> np.ndarray:
    """The distinct hashes of n consecutive words, in order; all the words as one if there are fewer; none without words."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * np.uint64(MULTIPLIER) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def _seeds(coordinates: int) -> np.ndarray:
    return mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(MULTIPLIER))


def signatures(sets: list[np.ndarray], seeds: np.ndarray, some: int = 1 << 15) -> list[np.ndarray]:
    """For each set, none of them empty, the upper 32 bits of the least scrambled hash under each seed."""
    out, i = [], 0
    while i < len(sets):
        j, n = i + 1, len(sets[i])
        while j < len(sets) and n + len(sets[j]) <= some:
            n += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]], dtype=np.int64)))
        least = np.empty((j - i, len(seeds)), np.uint64)
        for k, seed in enumerate(seeds):
            x = (flat ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            least[:, k] = np.minimum.reduceat(x, starts)
        out += list((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
        i = j
    return out


def _salted(rows: DataFrame, member: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with sizes by b, a hot b's rows by (b, salt): sizes is repeated SALTS times, rows aren't."""
    own = rows.withColumn("salt", F.pmod(F.xxhash64("b", member), F.lit(SALTS)).cast("int"))
    return own.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["b", "salt"], how).drop("salt")


def _print(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _base(docs: DataFrame, n: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    def batch(b: pa.RecordBatch) -> dict:
        seeds, ids = _seeds(coordinates), b.column(0).is_valid().to_pylist()
        sets = [shingles(raw, n) for raw in raw_bytes(b)]
        linked = [len(s) > 0 and ok for s, ok in zip(sets, ids)]
        made = iter(signatures([s for s, ok in zip(sets, linked) if ok], seeds))
        return {
            "doc_id": b.column(0),
            "n_shingles": [len(s) for s in sets],
            "fp": [_print(s) if ok else None for s, ok in zip(sets, linked)],
            "sig": [next(made) if ok else None for ok in linked],
        }

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, batch, f"doc_id {kind}, n_shingles long, fp binary, sig array<int>", rows=500)


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int, spread: int = 256) -> DataFrame:
    """Of (a, b), those with 100 * intersection >= percent * union of their sets.

    Rows of b's partners are dealt by b, in parts of about `spread`, each part
    led by b's own row: a set is made once per part, and a hot b is split.
    """
    hot = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > spread)
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / spread)).cast("int")
    dealt = _salted(pairs, "a", hot, "left").select("a", "b", F.coalesce(part, F.lit(0)).alias("part"))
    leads = dealt.select("b", "part").distinct().join(texts.select(F.col("cid").alias("b"), "text"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    others = dealt.join(texts.select(F.col("cid").alias("a"), "text"), "a").select("b", "part", "a", "text")
    rows = leads.unionByName(others).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, None
        for batch in batches:
            out = ([], [])
            bs, parts, members = (batch.column(k).to_pylist() for k in range(3))
            for b, part, a, raw in zip(bs, parts, members, raw_bytes(batch)):
                own = shingles(raw, n)
                if a is None:
                    at, lead = (b, part), own
                elif at == (b, part):
                    both = len(np.intersect1d(lead, own, assume_unique=True))
                    if 100 * both >= percent * (len(lead) + len(own) - both):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def collisions(sigs: np.ndarray, own: np.ndarray, least: int) -> np.ndarray:
    """Where rows of sigs match own in `least` coordinates or more: those without a match in the prefix are skipped, the others merged on."""
    prefix = sigs.shape[1] - least + 1
    count = (sigs[:, :prefix] == own[:prefix]).sum(1)
    met = np.flatnonzero(count)
    count[met] += (sigs[met, prefix:] == own[prefix:]).sum(1)
    return count >= least


def links_between(members: list[tuple], percent: int, least: int) -> list[tuple[int, int]]:
    """Links that join components, from members (cid, component, apart, side, signature, set): at most one fewer than there are members.

    Every pair of different components that collides in `least` coordinates is
    compared exactly, unless their `apart` is equal, on sides 0 and 1 only across; one member's intersections
    with all others come from one pass over the shingles that occur twice. A
    pair whose components a link has already joined needs no other.
    """
    sizes, sigs = np.array([len(m[5]) for m in members]), np.stack([m[4] for m in members])
    comp, apart, side = (np.array([m[k] for m in members]) for k in (1, 2, 3))
    owner = np.repeat(np.arange(len(members)), sizes)
    _, ids, count = np.unique(np.concatenate([m[5] for m in members]), return_inverse=True, return_counts=True)
    twice = count > 1
    place = np.cumsum(twice) - 1
    keep = twice[ids]
    flat, owner = place[ids[keep]], owner[keep]
    edges = np.searchsorted(owner, np.arange(len(members) + 1))
    mark, out = np.zeros(int(twice.sum()), bool), []
    for i in range(len(members) - 1):
        open_ = _open(comp, apart, side, i) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))
        if not open_.any() or edges[i] == edges[i + 1]:
            continue
        open_ &= collisions(sigs[i + 1 :], sigs[i], least)
        if not open_.any():
            continue
        own = flat[edges[i] : edges[i + 1]]
        mark[own] = True
        total = np.concatenate(([0], np.cumsum(mark[flat[edges[i + 1] :]])))
        both = total[edges[i + 2 :] - edges[i + 1]] - total[edges[i + 1 : -1] - edges[i + 1]]
        mark[own] = False
        for j in (i + 1 + np.flatnonzero(open_ & (100 * both >= percent * (sizes[i + 1 :] + sizes[i] - both)))).tolist():
            if comp[i] != comp[j]:
                out.append((members[i][0], members[j][0]))
                comp[comp == comp[j]] = comp[i]
    return out


def _open(comp: np.ndarray, apart: np.ndarray, side: np.ndarray, i: int) -> np.ndarray:
    """Which members after i are of another component, with another `apart`, and of the other side unless theirs is 2."""
    found = (comp[i + 1 :] != comp[i]) & (apart[i + 1 :] != apart[i])
    return found if side[i] == 2 else found & (side[i + 1 :] != side[i])


def _by_task(batches: Iterator[pa.RecordBatch], keys: int, coordinates: int) -> Iterator[tuple[tuple, list]]:
    """(key, rows) of consecutive rows with equal first columns; a column `sig` comes as arrays, `text` as bytes."""
    at, own = None, []
    for batch in batches:
        cols = []
        for name in batch.schema.names:
            col = batch.column(name)
            cols.append(col.flatten().to_numpy().reshape(-1, coordinates) if name == "sig" else raw_bytes(batch) if name == "text" else col.to_pylist())
        for row in zip(*cols):
            if at != row[:keys]:
                if own:
                    yield at, own
                at, own = row[:keys], []
            own.append(row[keys:])
    if own:
        yield at, own


def _colliding(rows: DataFrame, least: int, coordinates: int) -> DataFrame:
    """Of rows (b, x, y, cid, comp, apart, side, sig), sorted by (b, x, y), those that collide with one that is open to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _by_task(batches, 3, coordinates):
            cids, comp, apart, side = (np.array([m[k] for m in own]) for k in range(4))
            sigs, met = np.stack([m[4] for m in own]), np.zeros(len(own), bool)
            for i in range(len(own) - 1):
                found = np.flatnonzero(_open(comp, apart, side, i)) + i + 1
                found = found[collisions(sigs[found], sigs[i], least)] if len(found) else found
                met[found], met[i] = True, met[i] or len(found) > 0
            if met.any():
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, coordinates * (met.sum() + 1), coordinates, dtype=np.int32)), pa.array(sigs[met].ravel()))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(met.sum(), k)) for k in key), *(pa.array(c[met]) for c in (cids, comp, apart, side)), flat], names=["b", "x", "y", "cid", "comp", "apart", "side", "sig"])

    return rows.mapInArrow(run, "b long, x long, y long, cid long, comp long, apart long, side long, sig array<int>")


def _settle(rows: DataFrame, n: int, percent: int, least: int, coordinates: int) -> DataFrame:
    """links_between() of each group of rows (b, x, y, cid, comp, apart, side, sig, text), sorted by (b, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_task(batches, 3, coordinates):
            out = links_between([(*m[:5], shingles(m[5], n)) for m in own], percent, least)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else ((), ()))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _dealt(groups: DataFrame, block: int, block_shingles: int, homes: bool) -> DataFrame:
    """(b, x, y, cid, comp, apart, side) of groups (b, cid, size, comp, apart) that hold open pairs, dealt to pairs of blocks (x, y).

    Rows of equal `apart` needn't meet. With homes, those of a large group's
    most frequent `apart` have blocks of their own, which meet others' blocks
    only: such a row is sent once for each of those.
    """
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(size) / block_shingles)).cast("int")
    of = groups.groupBy("b", "apart").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    of = of.groupBy("b").agg(F.count("*").alias("aparts"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("n", "apart", "size")).alias("most"))
    of = of.where("aparts > 1 and lo != hi").withColumn("split", F.lit(homes) & (parts("n", "all") > 1)).select(
        "b",
        F.when(F.col("split"), F.col("most.apart")).alias("main"),
        F.when(F.col("split"), F.col("n") - F.col("most.n")).otherwise(F.col("n")).alias("rest"),
        F.when(F.col("split"), F.col("all") - F.col("most.size")).otherwise(F.col("all")).alias("rest_size"),
        F.when(F.col("split"), F.col("most.n")).otherwise(0).alias("n"),
        F.when(F.col("split"), F.col("most.size")).otherwise(0).alias("all"),
    )
    rows = _salted(groups, "cid", of.select("b", "main", parts("rest", "rest_size").alias("others"), parts("n", "all").alias("mains")))
    main = F.coalesce(F.col("apart") == F.col("main"), F.lit(False))
    hashed = lambda n: F.pmod(F.xxhash64("cid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = rows.withColumn("mine", F.when(main, F.col("others") + hashed("mains")).otherwise(hashed("others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(main, 0).otherwise(F.col("mains")))))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") < F.col("other")).cast("int"))
    return rows.select("b", F.least("mine", "other").cast("long").alias("x"), F.greatest("mine", "other").cast("long").alias("y"), "cid", "comp", "apart", side.alias("side"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, coordinates: int = 64, least: int = 30, block: int = 512, block_shingles: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Linked are documents whose sets of n-word shingles (ASCII lower case, words
    between ASCII white space) have 100 * intersection >= percent * union;
    component_id is the smallest id reachable over links, kept says that it is
    the document's own. Null and empty texts and those without words have no
    set and are linked with nothing; so are rows with a null id (component_id
    null, kept). Rows that repeat an id are documents of their own with the
    same id. Very long texts are taken whole. Columns other than the two named
    are not looked at. An empty table gives no rows.
    """
    base = materialize(_base(docs, n, coordinates, id_col, text_col), "sets")
    classes = base.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    posts = classes.select("cid", F.posexplode("sig").alias("pos", "value")).select("cid", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("df"), F.min("cid").alias("b")).where("df > 1")
    own = posts.join(shared.hint("shuffle_hash"), "key").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "key", "b"))).alias("p")).where(F.size("p") >= least)
    prefix = F.slice("p", 1, F.size("p") - (least - 1))  # the rarest of all, less those that nobody shares
    stars = own.select(F.col("cid").alias("a"), F.explode(F.array_distinct(F.transform(prefix, lambda x: x.b))).alias("b")).where("a != b")
    stars = materialize(stars, "stars")

    sig = classes.select(F.col("cid").alias("a"), F.col("sig").alias("own"))
    counted = stars.join(sig, "a").join(sig.select(F.col("a").alias("b"), F.col("own").alias("other")), "b")
    matches = F.aggregate(F.zip_with("own", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = materialize(counted.where(matches >= least).select("a", "b"), "pairs")

    def texts_of(cids: DataFrame, name: str) -> DataFrame:
        """(cid, text) of one row of each class; an id can be repeated: only a row with the class's set counts."""
        wanted = cids.join(classes.select("cid", "rep", "fp"), "cid")
        found = id_text(docs, id_col, text_col).join(wanted, F.col("doc_id") == F.col("rep")).select("cid", "fp", "text")

        seen: set[int] = set()  # of one task; rows that repeat id and text meet there, and what is left of them does no harm

        def right(b: pa.RecordBatch) -> dict:
            ok = []
            for cid, raw, fp in zip(b.column(0).to_pylist(), raw_bytes(b), b.column(1).to_pylist()):
                ok.append(cid not in seen and _print(shingles(raw, n)) == fp)
                if ok[-1]:
                    seen.add(cid)
            return {"cid": b.column(0).filter(pa.array(ok)), "text": b.column(2).filter(pa.array(ok))}

        return materialize(arrow_map(found, right, "cid long, text string", rows=500), name)

    texts = texts_of(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct(), "texts")
    links = materialize(_confirm(pairs, texts, n, percent), "links")
    labels = materialize(connected_components(links), "labels")

    members = stars.union(stars.select(F.col("b").alias("a"), "b").distinct()).select("b", F.col("a").alias("cid")).join(classes.select("cid", "size"), "cid")
    members = members.withColumn("n", F.count("*").over(Window.partitionBy("b")))
    home = F.max(F.struct("n", "b")).over(Window.partitionBy("cid"))["b"]
    members = materialize(members.withColumn("home", home).select("b", "cid", "size", "home"), "members")
    for homes in (False, True):  # first pairs with the same home, each in one group; then the other pairs
        own = members.withColumn("apart", F.col("home")) if homes else members.where("b = home").withColumn("apart", F.col("cid"))
        groups = own.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").select("b", "cid", "size", F.coalesce("component", "cid").alias("comp"), "apart")
        rows = _dealt(materialize(groups, "groups"), block, block_shingles, homes).join(classes.select("cid", "sig"), "cid").select("b", "x", "y", "cid", "comp", "apart", "side", "sig")
        met = materialize(_colliding(rows.repartition("b", "x", "y").sortWithinPartitions("b", "x", "y"), least, coordinates), "colliding")
        if met.limit(1).count():
            texts = texts.union(texts_of(met.select("cid").distinct().join(texts.select("cid"), "cid", "left_anti"), "more_texts"))
            rows = met.join(texts, "cid").select("b", "x", "y", "cid", "comp", "apart", "side", "sig", "text")
            links = links.union(materialize(_settle(rows.repartition("b", "x", "y").sortWithinPartitions("b", "x", "y"), n, percent, least, coordinates), "more"))
            labels = materialize(connected_components(links), "labels")

    label = classes.select("cid", "fp", "rep", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    label = materialize(label, "label")
    least_id = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least_id, "component").select("fp", "copies", "component_id")

    # a set that a thousandth of all rows share can be one of a thousand sets only: their labels are broadcast, and no such rows meet in one task
    many = max(1000, (classes.agg(F.sum("copies")).first()[0] or 0) // 1000)
    base = base.select("doc_id", "n_shingles", "fp")
    hot = F.broadcast(label.where(F.col("copies") > many).select("fp", "component_id"))
    rare = base.join(F.broadcast(classes.where(F.col("copies") > many).select("fp")), "fp", "left_anti").where("fp is not null")
    out = rare.join(label.select("fp", "component_id"), "fp").unionByName(base.join(hot, "fp")).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(base.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
