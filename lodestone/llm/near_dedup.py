"""MinHash near-duplicates by a chosen-path set similarity join.

Every document becomes a set of word shingles. Independent trees branch the sets recursively: a node's
sets are split by their minwise token under that tree's next hash function, so similar sets tend to stay
together (with probability equal to their Jaccard similarity at each branching). Nodes of at most
``leaf`` sets are compared exhaustively on short sketches; larger ones link each member to a leader
and branch on.

Links are confirmed on full sets, with integers, in two phases. The first takes a spanning forest of each
node's similar pairs, so its rows grow with the documents and not with the square of a group, and compares
the resulting groups in full, at most CHUNK members and about SHINGLES shingles at a time. The second goes
through all nodes again and confirms every similar pair whose ends the first left in different components, in
groups again; in large nodes of the last level, sketches of what stands apart from the node's largest component
meet those of all members in blocks, and what agrees there is confirmed. So no link between components goes
unseen among sets that meet in a node compared in full.

What moves: (node, set) keys of all sets, sketches only of sets that share a node, texts only of sets with a
similar one, once for each comparison. Lists of large nodes and of the texts' keys are broadcast up to a checked
number of rows and joined by shuffle beyond; a large node's rows are never dealt by the node alone while its
list is broadcast.

* Equal sets are one class from the start, whatever the number of copies: only classes are branched.
* A null, empty or blank text has an empty set: it is its own component.
* Rows that repeat (same id and text) are in one class and get the same result; a null id never
  names a component unless its component has no other id. An empty table gives an empty result.
* Ties: a component is named by its smallest id; equal ids are judged alike, so all rows of that id are kept.
* Very long texts: hashed in stretches of a few MB; a worker holds the shingle hashes (8 bytes a word) of one
  comparison group, of about SHINGLES shingles, or of two sets where single sets are larger.
* Extra columns are ignored, whatever their names.
* Recall: a pair of similarity 0.8 that never meets a node above ``leaf`` is missed with probability
  0.2 ** trees (1e-12 at 17 trees). Where nodes stay above ``leaf`` on all levels before the last, it meets
  in full only at the fourth token and is missed with (1 - 0.8 ** 4) ** 17 = 1.3e-4, unless other links join
  its ends. The sketch filter lies 4.5 standard deviations below the threshold (68 places).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY_ROWS, components, in_arrow, row_key, scratch, small_side, stage, unstage
from .textnum import U, flat, mix, pieces, shingle_sets, small, white_lut

TREES, DEPTH, SKETCH, LEAF, CHUNK, PANEL = 17, 4, 64, 64, 128, 64
SHINGLES = 4_000_000


def _binary16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.empty((len(a), 2), dtype=">u8")
    raw[:, 0], raw[:, 1] = a, b
    return pa.array([x.tobytes() for x in raw], pa.binary())


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional byte array as binary values."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _sketcher(words: int, functions: int, trees: int, depth: int):
    """Set size, class (a 128-bit hash of the set) and ``low``: one byte of each minwise token (the sketch), the
    64-bit first token of each tree, 24 bits of each further one."""
    first = np.arange(trees) * depth
    further = np.array([t * depth + d for t in range(trees) for d in range(1, depth)], int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, c2 = white_lut(), U(0xD6E8FEB86659FD93)
        seeds = mix(np.arange(1, functions + 1, dtype=U) * U(0xA0761D6478BD642F))
        for batch in small(batches, "_t"):
            data, offsets = flat(batch.column("_t"))
            for i, j in pieces(offsets):
                part = offsets[i : j + 1] - offsets[i]
                s, at, n = shingle_sets(data[offsets[i] : offsets[j]], part, words, lut)
                m = j - i
                sums, low = np.zeros((2, m), U), np.zeros((functions, m), U)
                full = np.flatnonzero(n)
                if len(full):
                    cuts = at[full]
                    sums[0, full] = np.add.reduceat(mix(s), cuts)
                    sums[1, full] = np.add.reduceat(mix(s * c2), cuts)
                    for f in range(functions):
                        v = s ^ seeds[f]
                        v *= seeds[f] | U(1)
                        v ^= v >> U(29)
                        low[f, full] = np.minimum.reduceat(v, cuts)
                tokens = np.ascontiguousarray(mix(low).T).view(np.uint8).reshape(m, functions, 8)
                packed = [tokens[:, :, 0], tokens[:, first].reshape(m, -1), tokens[:, further, 1:4].reshape(m, -1)]
                yield pa.record_batch(
                    {
                        "_id": batch.column("_id").slice(i, m),
                        "_k": batch.column("_k").slice(i, m),
                        "n": pa.array(n.astype(np.int64)),
                        "cls": _binary16(mix(sums[0] ^ n.astype(U)), sums[1]),
                        "low": _bytes(np.concatenate(packed, axis=1)),
                    }
                )

    return run


def _agreement(x: np.ndarray) -> np.ndarray:
    return (x[:, None, :] == x[None, :, :]).mean(axis=2)


def _by_node(close, columns: tuple[str, ...], out: dict[str, pa.DataType]):
    """Rows sorted by node: ``close(lists of columns)`` yields result rows for each node (at most ``leaf`` rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, rows = None, [], []

        def flush():
            cols = list(zip(*rows)) or [()] * len(out)
            return pa.record_batch({k: pa.array(c, t) for (k, t), c in zip(out.items(), cols)})

        for batch in batches:
            for k, *row in zip(*(batch.column(x).to_pylist() for x in ("node", *columns))):
                if k != node:
                    if len(held) > 1:
                        rows.extend(close(*zip(*held)))
                    node, held = k, []
                held.append(row)
            if len(rows) > 20_000:
                yield flush()
                rows = []
        if len(held) > 1:
            rows.extend(close(*zip(*held)))
        yield flush()

    return run


def _forest(least: float):
    """A spanning forest, most similar pairs first, of a node's pairs that agree on ``least`` of all places."""

    def close(classes, sigs):
        x = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
        agree = np.triu(_agreement(x), 1)
        i, j = np.nonzero(agree >= least)
        order = np.argsort(-agree[i, j], kind="stable")
        root = list(range(len(x)))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p, q in zip(i[order].tolist(), j[order].tolist()):
            if (a := find(p)) != (b := find(q)):
                root[a] = b
                yield min(classes[p], classes[q]), max(classes[p], classes[q]), float(agree[p, q])

    return _by_node(close, ("cls", "sig"), {"a": pa.binary(), "b": pa.binary(), "est": pa.float64()})


def _apart(least: float, shingles: int = SHINGLES):
    """A node's members that are similar to one with another label, as a group named by its members: trees
    that meet in the same members name the same group. Where their sets are too large together, each similar
    pair is a group."""

    def named(members: list[bytes]):
        g = int.from_bytes(hashlib.blake2b(b"".join(members), digest_size=8).digest(), "big", signed=True)
        for c in members:
            yield c, g

    def close(classes, sigs, sizes, labels):
        names = {v: k for k, v in enumerate(set(labels))}
        if len(names) > 1:
            lab = np.array([names[v] for v in labels])
            x = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
            near = (_agreement(x) >= least) & (lab[:, None] != lab[None, :])
            some = np.flatnonzero(near.any(axis=1))
            if sum(sizes[k] for k in some) <= shingles:
                yield from named(sorted({classes[k] for k in some}))
            else:
                for i, j in zip(*np.nonzero(np.triu(near, 1))):
                    yield from named(sorted((classes[i], classes[j])))

    return _by_node(close, ("cls", "sig", "n", "l"), {"cls": pa.binary(), "g": pa.int64()})


def _agreeing(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                est = (x == y).mean(axis=1)
                keep = pa.array(est >= least)
                yield pa.record_batch({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "est": pa.array(est[est >= least])})

    return run


def intersections(sets: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections: products of incidence matrices, ``width`` shared elements at a time."""
    n = len(sets)
    out = np.zeros((n, n))
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    size = np.diff(np.append(first, len(every)))
    shared = np.repeat(size > 1, size)
    owner = owner[shared]
    column = np.repeat(np.arange((size > 1).sum()), size[size > 1])
    for at in range(0, int((size > 1).sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        x = np.zeros((n, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out + np.diag([len(x) for x in sets]) - np.diag(np.diag(out))


def _confirm(words: int, percent: int):
    """Rows sorted by group: links (a, b) that span each group's true components, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, group, held, out_a, out_b = white_lut(), None, [], [], []

        def close() -> None:
            if len(held) < 2:
                return
            n = np.array([len(x) for _, x in held])
            both = intersections([x for _, x in held])
            root = list(range(len(held)))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))):
                if (x := find(int(i))) != (y := find(int(j))):
                    root[y] = x
                    out_a.append(held[x][0])
                    out_b.append(held[y][0])

        for batch in small(batches, "_t"):
            data, offsets = flat(batch.column("_t"))
            keys, classes = batch.column("g").to_pylist(), batch.column("cls").to_pylist()
            for i, j in pieces(offsets, 1 << 21):
                s, at, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, lut)
                for d in range(i, j):
                    if keys[d] != group:
                        close()
                        group, held = keys[d], []
                    if not held or held[-1][0] != classes[d]:  # a row that repeats comes once more
                        held.append((classes[d], s[at[d - i] : at[d - i] + n[d - i]].copy()))
            if out_a:
                yield pa.record_batch({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})
                out_a, out_b = [], []
        close()
        yield pa.record_batch({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


_PAIR = "a binary, b binary"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _few(keys: DataFrame) -> DataFrame:
    """Narrow keys (staged): broadcast up to KEY_ROWS."""
    return small_side(keys, KEY_ROWS)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, with_key: bool = False,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``; ``with_key`` adds the
    row's key (_k) and class (cls, null for an empty set)."""
    with scratch():
        out = _judged(docs, words, percent, id_col, text_col, trees, depth, leaf, with_key)
        return stage(out, "near-result", keep=True)


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, trees: int, depth: int, leaf: int, with_key: bool) -> DataFrame:
    functions = max(SKETCH, trees * depth)
    share = percent / 100
    spread = (share * (1 - share) / functions) ** 0.5
    least, strong = share - 4.5 * spread, share - 2 * spread
    key, text = row_key(id_col, text_col).alias("_k"), F.coalesce(text_col, F.lit("")).cast("binary").alias("_t")
    source = docs.select(F.col(id_col).alias("_id"), key, text)
    id_type = dict(source.dtypes)["_id"]
    wide = stage(in_arrow(source, _sketcher(words, functions, trees, depth), f"_id {id_type}, _k binary, n bigint, cls binary, low binary"), "near-sketched")
    # One row for each distinct set: its sketch is the same on every copy.
    reps = stage(wide.where("n > 0").groupBy("cls").agg(F.min("_k").alias("_k"), F.any_value("n").alias("n"), F.any_value("low").alias("low")), "near-reps")
    base = stage(wide.drop("low"), "near-base")
    unstage(wide)
    sig = reps.select("cls", F.substring("low", 1, functions).alias("sig"), "n")

    tail = functions + 8 * trees  # behind it the further tokens, by tree
    path = [F.struct(F.xxhash64(F.lit(t), F.substring("low", functions + 8 * t + 1, 8)).alias("node"), F.substring("low", tail + 3 * (depth - 1) * t + 1, 3 * (depth - 1)).alias("rest")) for t in range(trees)]
    rows = reps.select("cls", F.explode(F.array(*path)).alias("p")).select("cls", "p.node", "p.rest")
    small, stars, large = [], [], None
    for d in range(depth):
        counted = stage(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), f"near-nodes{d}")
        big = counted.where(F.col("size") > leaf).select("node")
        some = not big.isEmpty()
        apart = rows.join(_few(big), "node", "left_anti") if some else rows
        # a set is named by 64 bits here, checked by the join with its sketch: two sets of one name both go on
        small.append(apart.select("node", F.xxhash64("cls").alias("_r")).join(counted.where(F.col("size") <= leaf).select("node"), "node", "left_semi"))
        if not some:
            large = None
            break
        large = stage(rows.join(_few(big), "node", "left_semi"), f"near-large{d}")
        if d in (0, depth - 1):
            leads = stage(large.groupBy("node").agg(F.min("cls").alias("a")), f"near-leads{d}")
            stars.append(large.join(_few(leads), "node").select("a", F.col("cls").alias("b")).where("a <> b"))
        if d + 1 < depth:
            rows = large.select("cls", F.xxhash64("node", F.substring("rest", 3 * d + 1, 3)).alias("node"), "rest")

    def sketched(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
        return in_arrow(both.select("a", "b", "sa", "sb"), _agreeing(least), _PAIR + ", est double")

    leaves = stage(_union(small).join(sig.withColumn("_r", F.xxhash64("cls")), "_r").drop("_r"), "near-leaves")
    found = [in_arrow(leaves.select("node", "cls", "sig").repartition("node").sortWithinPartitions("node"), _forest(least), _PAIR + ", est double")]
    if stars:
        leaders = _union(stars).groupBy("b").agg(F.array_distinct(F.array(F.min("a"), F.max("a"))).alias("a"))  # two for each set
        found.append(sketched(leaders.select(F.explode("a").alias("a"), "b")))
    edges = stage(_union(found).groupBy("a", "b").agg(F.max("est").alias("est")), "near-edges")

    label = None
    if large is not None or not edges.isEmpty():
        # the only move of texts: one row of each class that has a similar one
        def pulled(classes: DataFrame, name: str) -> DataFrame:
            involved = stage(classes.join(reps.select("cls", "_k", "n"), "cls"), f"{name}-involved")
            return stage(docs.select(key, text).join(_few(involved), "_k").select("cls", "n", "_t").dropDuplicates(["cls"]), name)

        ends = stage(edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "near-ends")
        texts = pulled(ends, "near-texts")
        label = _first_components(edges.where(F.col("est") >= strong).select("a", "b"), texts, words, percent)
        # second phase: similar pairs still apart
        members = [_labelled(leaves, label)]
        if large is not None:
            members.append(_blocks(_labelled(large.select("node", "cls"), label), sig))
        members = _union(members).repartition("node").sortWithinPartitions("node")
        groups = stage(in_arrow(members, _apart(least), "cls binary, g bigint").distinct(), "near-apart")
        more = stage(groups.select("cls").distinct().join(ends, "cls", "left_anti"), "near-more")
        if not more.isEmpty():
            texts = texts.unionByName(pulled(more, "near-texts2"))
        label = components(_compared(texts, groups, words, percent), "near-final", label)

    first = base.where("n > 0").groupBy("cls").agg(F.min("_id").alias("first"))
    if label is None:
        named = first.select("cls", F.col("first").alias("component_id"))
    else:
        lowest = stage(first.join(label, first.cls == label.v, "left").select("cls", F.coalesce("l", "cls").alias("l"), "first"), "near-labelled")
        named = lowest.join(lowest.groupBy("l").agg(F.min("first").alias("component_id")), "l").select("cls", "component_id")
    out = base.where("n > 0").select("_id", "n", "_k", "cls").join(named, "cls").select("_id", "n", "component_id", "_k", "cls")
    out = out.unionByName(base.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"), "_k", F.lit(None).cast("binary").alias("cls")))
    extra = ["_k", "cls"] if with_key else []
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), *extra)


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    return members.join(label, members.cls == label.v, "left").withColumn("l", F.coalesce("l", "cls")).drop("v")


def _blocks(member: DataFrame, sig: DataFrame) -> DataFrame:
    """Large nodes (node, cls, l) as blocks (node, cls, sig, n, l): every set outside its node's largest
    component meets all the node's sets in some block, at most about PANEL and CHUNK at a time."""
    member = stage(member, "near-member")
    sizes = member.groupBy("node", "l").count()
    top = sizes.groupBy("node").agg(F.max_by("l", F.struct("count", "l")).alias("top"), F.sum("count").alias("size"), F.max("count").alias("most"))
    top = top.where("size > most").select("node", "top", F.ceil((F.col("size") - F.col("most")) / PANEL).alias("rows"), F.ceil(F.col("size") / CHUNK).alias("cols"))
    member = member.join(_few(stage(top, "near-top")), "node").withColumn("lone", F.col("l") != F.col("top"))
    row, col = F.pmod(F.xxhash64("cls", F.lit(3)), "rows"), F.pmod(F.xxhash64("cls", F.lit(4)), "cols")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    places = F.array_union(
        F.when(F.col("lone"), F.transform(F.sequence(zero, F.col("cols") - one), lambda c: F.struct(row.alias("r"), c.alias("c")))).otherwise(F.array().cast("array<struct<r: bigint, c: bigint>>")),
        F.transform(F.sequence(zero, F.col("rows") - one), lambda r: F.struct(r.alias("r"), col.alias("c"))),
    )
    return member.join(sig, "cls").select("node", "cls", "sig", "n", "l", F.explode(places).alias("p")).select(F.xxhash64("node", "p.r", "p.c").alias("node"), "cls", "sig", "n", "l")


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, once if it repeats;
    documents without words all stay. Nulls, ties, repeats, empty tables and very long texts are as above;
    extra columns stay as they are. Texts do not move while the keys of the rows that go are few enough to
    broadcast."""
    with scratch():
        judged = near_duplicates(docs, words, percent, with_key=True)
        some = judged.groupBy("_k").agg(F.count("*").alias("copies"), F.bool_or("kept").alias("kept"), F.bool_or(F.col("cls").isNull()).alias("empty"))
        some = some.where("not empty and (copies > 1 or not kept)")
        some = stage(some.select("_k", F.col("kept").alias("again")), "near-changed", keep=True)
    name = "_k"
    while name in docs.columns:
        name += "_"
    keyed, keys = docs.withColumn(name, row_key("doc_id", "text")), some.withColumnRenamed("_k", name)
    once = keyed.join(_few(keys.select(name)), name, "left_anti").drop(name)
    again = keyed.join(_few(keys.where("again").select(name)), name, "left_semi")
    # rows that repeat may differ in other columns: one of them stays whole
    merged = again.groupBy(name).agg(F.any_value(F.struct(*[F.col(c) for c in docs.columns])).alias("_row")).select("_row.*")
    return once.unionByName(merged)


def _compared(texts: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    return in_arrow(texts.join(_few(groups), "cls").select("g", "cls", "_t").repartition("g").sortWithinPartitions("g", "cls"), _confirm(words, percent), _PAIR)


def _first_components(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Components by links confirmed within the components of ``pairs``, compared in random groups of at most
    about CHUNK sets and SHINGLES shingles. What a large component then leaves outside its largest part meets a
    random panel of that part."""
    label = components(pairs, "near-cand")
    label = label.join(texts.select(F.col("cls").alias("v"), "n"), "v")
    sizes = label.groupBy("l").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / SHINGLES)).alias("parts"))
    grouped = stage(label.join(_few(stage(sizes, "near-parts")), "l").withColumnRenamed("v", "cls"), "near-grouped")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cls"), "parts")).otherwise(0)
    now = components(_compared(texts, stage(grouped.select("cls", F.xxhash64("l", part).alias("g")), "near-groups0"), words, percent), "near-part0")
    big = grouped.where("parts > 1").select("cls", F.col("l").alias("comp"))
    if big.isEmpty():
        return now
    for seed in (1, 2):
        member = stage(big.join(now, big.cls == now.v, "left").select("cls", "comp", F.coalesce("l", "cls").alias("l")), f"near-members{seed}")
        top = member.groupBy("comp", "l").count().groupBy("comp").agg(F.max_by("l", F.struct("count", "l")).alias("top"))
        member = member.join(_few(stage(top, f"near-top{seed}")), "comp")
        rest = member.where("l <> top").groupBy("comp").agg(F.ceil(F.count("*") / (CHUNK - PANEL)).alias("parts"))
        rest = stage(rest, f"near-rest{seed}")
        if rest.isEmpty():
            break
        rest = _few(rest)
        lone = member.where("l <> top").join(rest, "comp").select("cls", F.xxhash64("comp", F.pmod(F.xxhash64("cls", F.lit(seed)), "parts")).alias("g"))
        rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("cls", F.lit(-seed)), "cls"))
        panel = member.where("l = top").withColumn("rank", rank).where(F.col("rank") <= PANEL).join(rest, "comp")
        panel = panel.select("cls", "comp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("p")).select("cls", F.xxhash64("comp", "p").alias("g"))
        groups = stage(lone.unionByName(panel), f"near-groups{seed}")
        now = components(_compared(texts, groups, words, percent), f"near-part{seed}", now)
    return now
