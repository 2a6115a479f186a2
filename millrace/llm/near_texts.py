"""Near-duplicate texts: a chosen-path join of shingle sets.

A text's set holds the shingles of its words, A-Z lower-cased. Texts with equal sets are one
class at once. The classes are put into independent trees: at each node a minwise token is
chosen, and the classes go to the child of their own token there. Classes alone in a node
leave the tree, small nodes are compared exhaustively, large ones branch again, by several
tokens that the node's path chooses. Similar sets share a minwise token as often as they are
similar. A pair at a threshold of 85 % is missed by all trees with a chance below 1e-6, one at
80 % that goes through all levels with one of 5e-6, and more similar pairs still less.

Inside a node, sketches of the minwise tokens estimate similarity. The texts that may have a
link there, and no others, are brought to the node and compared exactly, on the full sets of
their whole texts; of two texts that meet in several nodes only the least node takes care.
What leaves a node is links that join groups, fewer than its texts, and never its pairs.
Nodes that stay large are cut into chunks, and each chunk is compared in itself first. If most
of a node is then one component, a group of near copies, the texts outside it meet every
chunk, while those inside it have nothing left to find among each other. If not, its texts
share a passage and little more: such a node, if it is a crowd, branches on by further tokens,
until its parts are small or alike.

Defined results: a null or empty text, or one without words, has an empty set and no links;
a text with fewer words than a shingle has one shingle, the sequence of its words; a null id
is linked with nothing; rows that repeat an id but not its text are documents of their own,
each with its own links; rows that repeat both are one document; an empty table gives no
rows; only the id and the text are read. Fingerprints of 64 bits stand for shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.durable import materialise, spread, tasks_for
from .batches import sliced

#: Minwise tokens of a class, independent trees, tokens chosen at a node that branches, levels.
TOKENS, TREES, BRANCHES, LEVELS = 96, 10, 2, 4
#: A node up to this size is compared exhaustively; also the size of chunks.
SMALL = 256
#: A node's members may be alike when a child keeps more than this share of them.
SHRINKS = 0.3
#: A node is alike when one component is more than this share of it, or one child; others branch on, by so many levels.
ALIKE, MORE_LEVELS = 0.6, 7
#: A node up to this size may meet all its chunks, alike or not: some 1e8 comparisons of sketches, dealt over thousands of tiles.
CROWD = 1 << 14
#: Classes that are broadcast at most to pick their texts, some 8 MB; beyond it all texts are shuffled to them.
MOST_BROADCAST_IDS = 250_000
#: Minwise tokens in which a pair may fall short of the threshold, in standard deviations, before it is compared on full
#: sets. A pair at the threshold falls short by more with a chance of 3e-6; closer pairs are surer. A recall parameter.
SHORT_BY = 4.5
#: Pairs of leaves that are compared at a time.
LEAF_PAIRS = 4_000_000
#: Longer words are hashed one by one.
LONG_WORD = 1024

_SEED = np.random.Generator(np.random.PCG64(7_2025))
_TABLE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B = _SEED.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _SEED.integers(0, 2**64, TOKENS, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def _words(raw: np.ndarray) -> np.ndarray:
    """A hash of every word of some bytes, lower-cased, in order."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[:-1], out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = raw[starts[i] : ends[i]].tobytes().lower()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A hash of every word of a text; a long text is taken in pieces that end at white space."""
    if len(text) <= piece:
        return _words(np.frombuffer(text, np.uint8))
    raw, parts, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        end = at + piece
        while end < len(raw) and not _SPACE[raw[end]]:
            step = _SPACE[raw[end : end + 4096]]
            end += int(step.argmax()) if step.any() else len(step)
        parts.append(_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted set of a text's shingles."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    out = np.full(n - size + 1, size * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        out = _mix(out ^ words[i : n - size + 1 + i]) if i else out + words[: n - size + 1]
    return np.unique(out)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``TOKENS`` minwise values of each set, which is not empty."""
    flat, heads = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), TOKENS), np.uint32)
    for j in range(TOKENS):
        out[:, j] = np.minimum.reduceat((flat * _A[j] + _B[j]) >> np.uint64(32), heads)
    return out


def signatures(docs: DataFrame, id_column: str, text_column: str, width: int, minwise: bool) -> DataFrame:
    """``id, text_hash, n_shingles, k0, k1`` of every row: the set's size and its hash; with ``minwise`` also ``sketch, tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t or b"", width) for t in texts]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [
                batch.column("id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()),
                pa.array(keys[:, 0]), pa.array(keys[:, 1])
            ]
            names = ["id", "text_hash", "n_shingles", "k0", "k1"]
            if minwise:
                tokens, sketches = [None] * len(sets), [None] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    found = _signatures([sets[i] for i in full])
                    low = (found & np.uint32(255)).astype(np.uint8)
                    for row, i in enumerate(full):
                        tokens[i], sketches[i] = found[row].tobytes(), low[row].tobytes()
                columns += [pa.array(sketches, pa.binary()), pa.array(tokens, pa.binary())]
                names += ["sketch", "tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(_texts(docs, id_column, text_column)).mapInArrow(
        run, "id long, text_hash long, n_shingles long, k0 long, k1 long" + ", sketch binary, tokens binary" * minwise
    )


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, text_hash, text``; the hash tells apart the texts of rows that repeat an id."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _children(frame: DataFrame, branches: int) -> DataFrame:
    """``node, id, parent`` of the children that ``node, id, tokens`` go to; the node chooses the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy().astype(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            out = []
            for b in range(branches):
                path = _mix(node + np.uint64(b * 0x2545F491 + 1))
                # Two branches of a node never choose the same token.
                chosen = ((_mix(node) >> np.uint64(8)) + np.uint64(b)) % np.uint64(TOKENS)
                out.append(_mix(path ^ tokens[np.arange(len(node)), chosen.astype(np.int64)].astype(np.uint64)))
            ids, parents = (pa.concat_arrays([batch.column(c)] * branches) for c in ("id", "node"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), ids, parents], names=["node", "id", "parent"])

    return frame.select("node", "id", "tokens").mapInArrow(run, "node long, id long, parent long")


def leaves(classes: DataFrame, roots: DataFrame, branches: int = BRANCHES, levels: int = LEVELS, shrinks: float = SHRINKS) -> DataFrame:
    """``node, id, size`` for the classes in company at the ends of the trees that begin at ``node, id, tokens``.

    A large node whose largest child keeps more than ``shrinks`` of it is an end too: its
    members are alike, and further tokens would not tell them apart.
    """
    # The children of the roots are made twice, for the sizes and for those in company: most are alone.
    rows, ends, small = _children(roots, 1).select("node", "id"), [], F.col("size") <= SMALL
    # Every frame here has at most so many rows, or a few times as many; few rows need few tasks and files.
    tasks = tasks_for(classes.count() * TREES)
    sizes = materialise(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").coalesce(tasks))
    for level in range(levels):
        sized = materialise(rows.join(sizes, "node").select("node", "id", "size").coalesce(tasks))
        ends.append(sized.where(small) if level < levels - 1 else sized)
        large = sizes.where(~small)
        if level == levels - 1 or not large.take(1):
            break
        members = sized.where(~small)
        children = materialise(_children(members.join(classes.select("id", "tokens"), "id"), branches).coalesce(tasks))
        counts = children.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.first("parent").alias("parent")).where("size > 1")
        counted = materialise(counts.coalesce(tasks))
        kept = counted.groupBy("parent").agg(F.max("size").alias("most"))
        alike = large.join(kept, large["node"] == kept["parent"]).where(F.col("most") > shrinks * F.col("size"))
        stubborn = materialise(alike.select("node").coalesce(tasks))
        ends.append(materialise(members.join(stubborn, "node", "left_semi").coalesce(tasks)))
        gone = stubborn.select(F.col("node").alias("parent"))
        rows = children.join(gone, "parent", "left_anti").select("node", "id")
        sizes = counted.join(gone, "parent", "left_anti").select("node", "size")
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


_BYTES = {"sketch": TOKENS}


def _tiles(batches: Iterator[pa.RecordBatch], lists: str | None = None) -> Iterator[dict[str, np.ndarray | list]]:
    """The columns of each tile, from batches sorted by ``node, chunk, slot``.

    Fixed numbers become arrays, sketches a matrix, ``lists`` a matrix padded with -1, and
    anything else stays a list.
    """
    held: dict[str, np.ndarray | list] | None = None

    def joined(a, b):
        if isinstance(a, list):
            return a + b
        if a.ndim == 2 and a.shape[1] != b.shape[1]:
            wide = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=-1) for x in (a, b))
        return np.concatenate([a, b])

    # Few rows at a time: a batch is as large as the session has it.
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        columns: dict[str, np.ndarray | list] = {}
        for name, column in zip(batch.schema.names, batch.columns):
            if name in _BYTES:
                columns[name] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BYTES[name])
            elif name == lists:
                counts = np.diff(column.offsets.to_numpy())
                wide = np.full((len(column), int(counts.max())), -1, np.int64)
                wide[np.arange(wide.shape[1]) < counts[:, None]] = column.flatten().to_numpy()
                columns[name] = wide
            elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                columns[name] = column.cast(pa.large_binary()).to_pylist()
            else:
                columns[name] = column.to_numpy(zero_copy_only=False)
        keys = [columns[c] for c in ("node", "chunk", "slot")]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:]):
            part = {n: c[begin:end] for n, c in columns.items()}
            if held is not None and all(held[c][0] == part[c][0] for c in ("node", "chunk", "slot")):
                held = {n: joined(held[n], part[n]) for n in part}
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "node", "chunk", "slot").sortWithinPartitions("node", "chunk", "slot", "id")


_TILE = ("node", "chunk", "slot", "id", "group", "probe", "target")
_TILE_DDL = "node long, chunk int, slot int, id long, group long, probe boolean, target boolean"


def _involved(rows: DataFrame, least: float) -> DataFrame:
    """The rows of tiles that may have a link there, by their sketches.

    A probe and a target of different groups may be linked when enough of their minwise tokens
    agree. Two texts that meet in several nodes are looked at in the least of them only.
    """

    def found(part: dict[str, np.ndarray]) -> np.ndarray:
        ids, groups, sketch, leaves_ = part["id"], part["group"], part["sketch"], part["leaves"]
        probe, target = np.flatnonzero(part["probe"]), np.flatnonzero(part["target"])
        node, hit = part["node"][0], np.zeros(len(ids), bool)
        step = max(1, 20_000 // max(1, len(target)))
        for at in range(0, len(probe), step):
            p = probe[at : at + step]
            same = (sketch[p][:, None, :] == sketch[target][None, :, :]).sum(axis=2, dtype=np.uint8)
            row, column = np.nonzero((same >= least * TOKENS) & (groups[p, None] != groups[None, target]) & (ids[p, None] != ids[None, target]))
            # Few pairs at a time: every leaf of one is compared with every leaf of the other.
            few = max(1, LEAF_PAIRS // leaves_.shape[1] ** 2)
            for lo in range(0, len(row), few):
                one, two = p[row[lo : lo + few]], target[column[lo : lo + few]]
                new = ~(hit[one] & hit[two])
                one, two = one[new], two[new]
                if len(one):
                    shared = (leaves_[one][:, :, None] == leaves_[two][:, None, :]).any(axis=2) & (leaves_[one] != -1)
                    first = np.where(shared, leaves_[one], np.iinfo(np.int64).max).min(axis=1) == node
                    hit[one[first]] = hit[two[first]] = True
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for part in _tiles(batches, "leaves"):
            if len(part["id"]) > 1:
                hit = found(part)
                if hit.any():
                    held.append([part[c][hit] for c in _TILE])
                    count += int(hit.sum())
            if count > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=list(_TILE))
                held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=list(_TILE))

    return _dealt(rows).select(*_TILE, "sketch", "leaves").mapInArrow(run, _TILE_DDL)


def _linked(rows: DataFrame, texts: Texts, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` of involved rows, verified on full sets; inside a tile only those that join groups."""

    def found(part: dict[str, np.ndarray | list]) -> tuple[list[int], list[int]]:
        ids, label = part["id"], part["group"].copy()
        probe, target = np.flatnonzero(part["probe"]), np.flatnonzero(part["target"])
        sets = [shingles(x or b"", width) for x in part["text"]]
        target = target[[len(sets[t]) > 0 for t in target]] if len(target) else target
        a: list[int] = []
        b: list[int] = []
        if not len(target):
            return a, b
        sizes = np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate([sets[t] for t in target]), return_inverse=True)
        heads = np.cumsum(sizes[target]) - sizes[target]
        for p in probe:
            if (label[target] == label[p]).all():
                continue
            mark = np.zeros(len(known), np.int32)
            place = np.minimum(np.searchsorted(known, sets[p]), len(known) - 1)
            mark[place[known[place] == sets[p]]] = 1
            both = np.add.reduceat(mark[flat], heads)
            alike = target[100 * both >= percent * (sizes[p] + sizes[target] - both)]
            for other in np.unique(label[alike]):
                if other != label[p]:
                    a.append(int(ids[p]))
                    b.append(int(ids[alike[np.argmax(label[alike] == other)]]))
            label[np.isin(label, label[alike])] = label[p]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tiles(batches):
            a, b = found(part)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    wanted = rows.select("id").distinct().join(texts.heads, "id")
    small = wanted.count() <= MOST_BROADCAST_IDS
    wanted = F.broadcast(wanted) if small else wanted
    picked = texts.rows.join(wanted, ["doc", "text_hash"]).select("id", "text")
    # Rows that repeat an id and its text are one; seldom are there any, and then no text is shuffled for them.
    narrow = texts.rows.select("doc", "text_hash").join(wanted, ["doc", "text_hash"])
    if narrow.groupBy("id").count().where("count > 1").take(1):
        picked = picked.groupBy("id").agg(F.first("text").alias("text"))
    placed = rows.join(picked, "id")
    return _dealt(placed).select(*_TILE, "text").mapInArrow(run, "a long, b long")


class Texts(NamedTuple):
    """Where the text of a class is: ``rows`` has ``doc, text_hash, text``, ``heads`` has ``id, doc, text_hash`` of each class."""

    rows: DataFrame
    heads: DataFrame


def links(classes: DataFrame, texts: Texts, width: int, percent: int) -> DataFrame:
    """Verified links ``a, b`` between classes ``id, sketch, tokens``, enough to hold every component together."""
    share = percent / 100
    least = share - SHORT_BY * (share * (1 - share) / TOKENS) ** 0.5
    starts = F.explode(F.array(*(F.lit(t * 0x9E3779B1 + 1).cast("long") for t in range(TREES))))
    sketched = _sketched(leaves(classes, classes.select("id", "tokens", starts.alias("node"))), classes)
    found = _inside_chunks(sketched, F.col("id"), least, texts, width, percent)
    # Nodes of one chunk are settled.
    large = sketched.where("chunks > 1")
    if not large.take(1):
        return found
    grouped, mixed = _mixed(large, found)
    crowds = mixed.where((F.col("most") < ALIKE * F.col("all")) & (F.col("all") > CROWD)).select("node")
    if crowds.take(1):
        members = grouped.join(crowds, "node", "left_semi").select("node", "id").join(classes.select("id", "tokens"), "id")
        # The nodes' own numbers choose other tokens from here on.
        parted = _sketched(leaves(classes, members, levels=MORE_LEVELS, shrinks=ALIKE), classes)
        joined = _components(found).withColumnRenamed("component", "group")
        known = parted.join(joined, "id", "left").withColumn("group", F.coalesce("group", "id"))
        found = materialise(found.unionByName(_inside_chunks(known, F.col("group"), least, texts, width, percent)))
        rest = large.join(crowds, "node", "left_anti").unionByName(parted.where("chunks > 1").select(large.columns))
        grouped, mixed = _mixed(rest, found)
    # In the others, texts outside the largest component meet every chunk.
    mixed = materialise(grouped.join(mixed, "node"))
    own, always = _own_chunk(), F.lit(True)
    slots = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    slot = F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot")
    targets = mixed.select("node", own.alias("chunk"), slots, "id", "group", F.lit(False).alias("probe"), always.alias("target"), "sketch", "leaves")
    probes = mixed.where(F.col("group") != F.col("largest")).select(
        "node", chunks, slot, "id", "group", always.alias("probe"), F.lit(False).alias("target"), "sketch", "leaves"
    )
    more = _linked(materialise(_involved(targets.unionByName(probes), least)), texts, width, percent)
    return found.unionByName(more)


def _own_chunk():
    return F.pmod(F.xxhash64("id", "node"), F.col("chunks")).cast("int")


def _components(found: DataFrame) -> DataFrame:
    return connected_components(found).select(F.col("node").alias("id"), "component")


def _sketched(ends: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, id, size, leaves, sketch, chunks``: sketches are joined where they are compared, and nowhere stored with the nodes."""
    lists = ends.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    return ends.join(lists, "id").join(classes.select("id", "sketch"), "id").withColumn("chunks", F.ceil(F.col("size") / SMALL).cast("int"))


def _inside_chunks(sketched: DataFrame, group, least: float, texts: Texts, width: int, percent: int) -> DataFrame:
    """Links inside the chunks of nodes."""
    always = F.lit(True)
    rows = sketched.select(
        "node", _own_chunk().alias("chunk"), F.lit(0).alias("slot"), "id", group.alias("group"),
        always.alias("probe"), always.alias("target"), "sketch", "leaves"
    )
    return materialise(_linked(materialise(_involved(rows, least)), texts, width, percent))


def _mixed(large: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``large`` with groups, and ``node, largest, most, all, slots`` of its nodes that hold more than one group."""
    grouped = large.join(_components(found), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    parts = grouped.groupBy("node", "group").agg(F.count(F.lit(1)).alias("n"))
    tops = parts.groupBy("node").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") < F.col("all"))
    slots = F.ceil((F.col("all") - F.col("top.n")) / SMALL).cast("int").alias("slots")
    return grouped, materialise(tops.select("node", F.col("top.group").alias("largest"), F.col("top.n").alias("most"), "all", slots))


def judged(docs: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """``id, text_hash, n_shingles, component_id, head_hash`` of every row.

    The component is named by its least document, the one with the least id, and of those
    with that id the one with the least text hash, which is ``head_hash``.
    """
    # Sets are hashed twice: once with minwise tokens, which only classes keep, once for every row's size and class.
    full = signatures(docs, id_column, text_column, width, True).where("n_shingles > 0 and id is not null")
    # One row a class, of its least document; equal rows are combined before the shuffle. Classes are numbered, and the numbers stored.
    least = full.groupBy("k0", "k1").agg(F.min(F.struct("id", "text_hash", "sketch", "tokens")).alias("least"))
    number = F.monotonically_increasing_id().alias("id")
    classes = materialise(least.select(
        "k0", "k1", number, F.col("least.id").alias("doc"),
        *(F.col(f"least.{c}") for c in ("text_hash", "sketch", "tokens"))
    ))
    heads = classes.select("id", "doc", "text_hash")
    rows = _texts(docs, id_column, text_column).where("text is not null").withColumnRenamed("id", "doc")
    components = connected_components(links(classes.select("id", "sketch", "tokens"), Texts(rows, heads), width, percent))
    members = components.withColumnRenamed("node", "id").join(heads, "id")
    tasks = tasks_for(classes.count())
    leasts = materialise(members.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("head")).coalesce(tasks))
    few = leasts.count() <= MOST_BROADCAST_IDS
    of_class = components.join(F.broadcast(leasts) if few else leasts, "component").select(F.col("node").alias("id"), "head")
    own = F.struct("doc", "text_hash")
    named = materialise(classes.select("id", "k0", "k1", own.alias("own")).join(of_class, "id", "left").select(
        "k0", "k1", F.coalesce("head", "own").alias("head")
    ).coalesce(tasks))
    signed = signatures(docs, id_column, text_column, width, False)
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    out = signed.join(named, ["k0", "k1"], "left")
    named_by = lambda field, alone: F.when(linked, F.col(f"head.{field}")).otherwise(F.col(alone))
    return out.select(
        "id", "text_hash", "n_shingles", named_by("doc", "id").alias("component_id"),
        named_by("text_hash", "text_hash").alias("head_hash")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row of ``docs``.

    Sets are alike when ``100 * intersection >= percent * union``. The text is shuffled for
    classes with a proposed neighbour only.
    """
    out = judged(docs, id_column, text_column, width, percent)
    return out.select(
        F.col("id").alias(id_column), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does, with all their columns.

    Rows that repeat an id but not its text are judged each by its own text. Of rows that
    repeat both one stays; rows without an id all stay.
    """
    found = materialise(judged(docs, id_column, text_column, width, percent).where("id is not null"))
    stays = (F.col("id") == F.col("component_id")) & (F.col("text_hash") == F.col("head_hash"))
    gone = found.where(~stays).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    counts = found.where(stays).groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).count()
    repeated = materialise(counts.where("count > 1").select("__id", "__hash"))
    key = ["__id", "__hash"]
    own = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("__row"), F.col(id_column).cast("long").alias("__id"),
        F.xxhash64(F.col(text_column).cast("string")).alias("__hash")
    )
    stay = own.join(gone, key, "left_anti")
    if repeated.take(1):
        once = stay.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("__row", F.xxhash64(F.to_json("__row"))).alias("__row"))
        stay = stay.join(repeated, key, "left_anti").select("__row").unionByName(once.select("__row"))
    return stay.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
