"""Repeated byte strings across documents, by prefix-free parsing.

A byte is removed when a string of ``span`` bytes that covers it also starts in a document
with a smaller id. Strings are judged on the input, inside documents.

*Parse.* A rolling hash over ``width`` bytes triggers at the least value in every ``span``
bytes, so each ``span``-byte string holds a trigger, and equal strings hold it at the same
place. The strings that share a trigger occurrence follow each other; together they are the
phrase of that occurrence, and phrases overlap so that no string is cut. The *dictionary* is
the set of distinct phrases, the *parse* of a document its sequence of phrases.

*Order.* Only which suffixes agree in their first ``span`` bytes matters, not which sorts
first. So suffixes are ordered by fingerprints of those bytes in place of the bytes: first
whole phrases, grouped by their trigger, which settles every phrase that occurs in one form
only, for all suffixes at once; then, for triggers with several forms (the edges of repeated
passages), the suffixes of the distinct dictionary phrases themselves. In each group of equal
prefixes the smallest document id is kept. Repetitive text costs little: a phrase enters once
for each batch of documents, whatever its number of occurrences.

*Dealing.* Documents are dealt once into batches of a few MB. A batch sends each bucket of
fingerprints at most one entry for a phrase or suffix, and gets one or two bits back for each
entry. A passage that stands in a third of all documents so makes one entry a batch, and no
task or the driver ever holds its occurrences.

Defined results: a null text counts as empty; texts shorter than ``span`` lose nothing; rows
with the same id are not smaller than each other; a null id is greater than all others; all
rows are returned, repeated ones too, and rows that share an id are dealt by their texts; an
empty table gives no rows; only the id and the text are read. Fingerprints stand for strings:
a phrase is removed whole only if all forms of its trigger agree in 80 bits besides those of
the bucket, a suffix if another agrees with it in 96 bits besides those of the bucket, from
two rolling hashes with bases and tables of their own.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, WIDTH = 50, 24
#: String starts in one slice: arrays of this length are all the memory that hashing needs.
SLICE = 1 << 19
_POSITION = np.uint64((1 << 22) - 1)
_LAST = np.iinfo(np.int64).max
_SEVERAL = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64(0xFFFFFFFF)

_SEED = np.random.Generator(np.random.PCG64(20240229))
#: Tables and bases of the two rolling hashes.
_TABLES = _SEED.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    if which not in _powers:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(SLICE + 2 * SPAN + 2, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[which] = tuple(made)
    return _powers[which][0][:n], _powers[which][1][:n]


def _mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h ^ np.uint64(seed)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


class _Slice(NamedTuple):
    begin: int  # of its bytes in the batch
    end: int
    docs: np.ndarray  # documents, by number
    starts: np.ndarray  # their first bytes here
    ends: np.ndarray


class _Entries(NamedTuple):
    """What a batch sends: sorted by bucket; ``bounds`` are the buckets' places."""

    keys: np.ndarray
    forms: np.ndarray  # of phrases 48 bits, of suffixes 32 more bits of the key
    docs: np.ndarray
    bounds: np.ndarray


class Batch:
    """The parse of a few documents."""

    def __init__(self, table: pa.Table, buckets: int, span: int = SPAN, width: int = WIDTH):
        self.span, self.width, self.buckets = span, width, buckets
        self.window = span - width + 1
        ids = table.column("id").combine_chunks()
        self.ids = ids
        self.docs = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        # Offsets of 64 bits before chunks are joined: a batch may hold more than 2 GB.
        texts = table.column("text").cast(pa.large_binary()).combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
        texts = texts.fill_null(b"")
        self.offsets = np.frombuffer(
            texts.buffers()[1], np.int64
        )[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self._parse()

    def _slices(self):
        begin, count = 0, len(self.offsets) - 1
        while begin < count:
            end = begin + 1
            while end < count and self.offsets[end + 1] - self.offsets[begin] <= SLICE:
                end += 1
            lo, hi = int(self.offsets[begin]), int(self.offsets[end])
            if hi - lo <= SLICE:
                docs = np.arange(begin, end)
                yield _Slice(lo, hi, docs, self.offsets[begin:end] - lo, self.offsets[begin + 1 : end + 1] - lo)
            else:  # one long document: pieces that share span - 1 bytes
                for at in range(lo, hi, SLICE):
                    stop = min(hi, at + SLICE + self.span - 1)
                    yield _Slice(at, stop, np.array([begin]), np.array([0]), np.array([stop - at]))
            begin = end

    def _sums(self, s: _Slice, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        raw = self.data[s.begin : s.end]
        power, inverse = _power_tables(len(raw) + 1, which)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLES[which][raw] * power[:-1], out=sums[1:])
        return sums, inverse

    def _parse(self) -> None:
        span, width, parts = self.span, self.width, []
        self.slices = list(self._slices())
        for number, s in enumerate(self.slices):
            n = s.end - s.begin
            if n < span:
                continue
            sums, inverse = self._sums(s)
            grams = (sums[width:] - sums[:-width]) * inverse[: n - width + 1]
            least = grams ^ (grams >> np.uint64(32))
            least *= np.uint64(0xD6E8FEB86659FD93)
            least &= ~_POSITION
            least |= np.arange(len(least), dtype=np.uint64)
            size = 1
            while 2 * size <= self.window:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < self.window:
                least = np.minimum(least[: len(least) - (self.window - size)], least[self.window - size :])
            trigger = (least & _POSITION).astype(np.int64)
            left = np.repeat(s.ends, s.ends - s.starts)[: n - span + 1] - np.arange(n - span + 1)
            valid = left >= span
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
            last = valid.copy()
            last[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
            first, final = np.flatnonzero(new), np.flatnonzero(last)
            phrase = _mix(
                (sums[final + span] - sums[first]) * inverse[first] + (final - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F),
                0x51
            )
            parts.append((
                _mix(grams[trigger[first]], 0xA5), phrase, s.docs[np.searchsorted(s.starts, first, "right") - 1],
                first, final, np.full(len(first), number)
            ))
        if not parts:
            parts.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))))
        triggers, phrases, self.run_doc, self.first, self.final, self.run_slice = (np.concatenate(x) for x in zip(*parts))
        ids = self.docs[self.run_doc]
        place = ((triggers >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (triggers & _LOW32)
        forms = np.minimum(phrases >> np.uint64(16), _SEVERAL - np.uint64(1))
        order = np.lexsort((ids, forms, place))
        p, f, d = place[order], forms[order], ids[order]
        new_place = np.ones(len(p), bool)
        new_place[1:] = p[1:] != p[:-1]
        new_form = new_place.copy()
        new_form[1:] |= f[1:] != f[:-1]
        heads = np.flatnonzero(new_place)
        forms_each = np.add.reduceat(new_form.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        several = forms_each > 1
        group = np.empty(len(p), np.int64)
        group[order] = np.cumsum(new_place) - 1
        least_doc = np.empty(len(p), np.int64)
        form_heads = np.flatnonzero(new_form)
        least_doc[order] = d[form_heads][np.cumsum(new_form) - 1] if len(p) else d
        self.group, self.least_doc, self.several, self.run_id = group, least_doc, several, ids
        self.entries = _Entries(
            p[heads] & _LOW32, np.where(several, _SEVERAL, f[heads]), np.where(several, 0, d[heads]),
            np.searchsorted(p[heads] >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))
        )

    def decide(self, dup: np.ndarray, several: np.ndarray) -> None:
        """Use the answers for phrases: ``gone`` runs are removed whole, ``open`` ones by suffix."""
        elsewhere = dup[self.group] & ~self.several[self.group]
        self.gone = elsewhere | (self.run_id > self.least_doc)
        self.open = ~self.gone & (several | self.several)[self.group]

    def suffixes(self) -> _Entries:
        """The suffixes of the open phrases, once each, with the smallest document of the batch."""
        found, where = [], []
        for number in np.unique(self.run_slice[self.open]):
            chosen = np.flatnonzero(self.open & (self.run_slice == number))
            counts = self.final[chosen] - self.first[chosen] + 1
            starts = np.repeat(self.first[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            hashes = []
            for which in (0, 1):
                sums, inverse = self._sums(self.slices[number], which)
                hashes.append(_mix((sums[starts + self.span] - sums[starts]) * inverse[starts], 0x77))
            found.append(np.stack(hashes))
            where.append(np.stack([np.repeat(chosen, counts), starts]))
        keys, others = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
        self.suffix_run, self.suffix_start = np.concatenate(where, axis=1) if where else np.zeros((2, 0), np.int64)
        # The second hash gives the bucket with its upper half and 32 more bits of the key with its lower one.
        bucket, more, ids = (others >> np.uint64(32)) % np.uint64(self.buckets), others & _LOW32, self.run_id[self.suffix_run]
        order = np.lexsort((ids, more, keys, bucket))
        b, k, m, d = bucket[order], keys[order], more[order], ids[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1]) | (m[1:] != m[:-1])
        heads = np.flatnonzero(new)
        self.suffix_entry = np.empty(len(k), np.int64)
        self.suffix_entry[order] = np.cumsum(new) - 1
        self.suffix_least = d[heads]
        return _Entries(k[heads], m[heads], d[heads], np.searchsorted(b[heads], np.arange(self.buckets + 1, dtype=np.uint64)))

    def removed(self, dup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document numbers, begins and ends of the maximal removed runs; ``dup`` answers the suffixes."""
        base = np.array([s.begin for s in self.slices], np.int64)
        hit = dup[self.suffix_entry] | (self.run_id[self.suffix_run] > self.suffix_least[self.suffix_entry])
        run, start = self.suffix_run[hit], self.suffix_start[hit]
        gone = np.flatnonzero(self.gone)
        docs = np.concatenate([self.run_doc[gone], self.run_doc[run]])
        begins = np.concatenate([
            base[self.run_slice[gone]] + self.first[gone], base[self.run_slice[run]] + start
        ]) if len(base) else np.zeros(0, np.int64)
        ends = np.concatenate([
            base[self.run_slice[gone]] + self.final[gone], base[self.run_slice[run]] + start
        ]) + self.span if len(base) else np.zeros(0, np.int64)
        order = np.argsort(begins, kind="stable")
        docs, begins, ends = docs[order], begins[order], ends[order]
        new = np.ones(len(docs), bool)
        new[1:] = (begins[1:] > ends[:-1]) | (docs[1:] != docs[:-1])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(docs)]])[: len(heads)] - 1
        return docs[heads], begins[heads], ends[tails]


def _sent(batch: int, entries: _Entries, kind: int) -> pa.Table:
    """Rows ``(kind, bucket, batch, least, keys, forms, docs)``, one for each bucket with entries."""
    rows: dict[str, list] = {n: [] for n in _SENT.names}
    for bucket, (a, b) in enumerate(zip(entries.bounds[:-1], entries.bounds[1:])):
        if a == b:
            continue
        least = int(entries.docs[a:b].min())
        over = (entries.docs[a:b] - least).astype(np.uint64)
        rows["kind"].append(kind)
        rows["bucket"].append(bucket)
        rows["batch"].append(batch)
        rows["least"].append(least)
        rows["n"].append(int(b - a))
        rows["keys"].append(entries.keys[a:b].astype("<u4" if kind == 0 else "<u8").tobytes())
        upper = (entries.forms[a:b] >> np.uint64(32)).astype("<u2").tobytes() if kind == 0 else b""
        rows["forms"].append((entries.forms[a:b] & _LOW32).astype("<u4").tobytes() + upper)
        rows["docs"].append(over.astype("<u4" if over.max() < 1 << 32 else "<u8").tobytes())
    return pa.table(rows, schema=_SENT)


_SENT = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int32()), ("least", pa.int64()), ("n", pa.int32()),
    ("keys", pa.binary()), ("forms", pa.binary()), ("docs", pa.binary())
])
_SENT_DDL = "kind int, bucket int, batch int, least long, n int, keys binary, forms binary, docs binary"
_ANSWER = pa.schema([("kind", pa.int32()), ("batch", pa.int32()), ("bucket", pa.int32()), ("dup", pa.binary()), ("several", pa.binary())])
_ANSWER_DDL = "kind int, batch int, bucket int, dup binary, several binary"


def answer(sent: pa.Table) -> pa.Table:
    """For every entry of one bucket: whether a smaller document has it, and whether its trigger has several forms."""
    if not sent.num_rows:
        return _ANSWER.empty_table()
    sent = sent.sort_by("batch")
    columns = {n: sent.column(n).to_pylist() for n in sent.column_names}
    kind, sizes = columns["kind"][0], columns["n"]
    keys = np.concatenate([np.frombuffer(x, "<u4" if kind == 0 else "<u8") for x in columns["keys"]]).astype(np.uint64)
    docs = np.concatenate([
        np.frombuffer(x, "<u4" if len(x) == 4 * n else "<u8").astype(np.int64) + least for x, n,
        least in zip(columns["docs"], sizes, columns["least"])
    ])
    forms = np.concatenate([np.frombuffer(x, "<u4", n).astype(np.uint64) for x, n in zip(columns["forms"], sizes)])
    if kind == 0:
        forms |= np.concatenate([np.frombuffer(x, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32) for x, n in zip(columns["forms"], sizes)])
    order = np.lexsort((docs, forms, keys))
    k, f, d = keys[order], forms[order], docs[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_form = new_key.copy()
    new_form[1:] |= f[1:] != f[:-1]
    heads = np.flatnonzero(new_key)
    many = (np.add.reduceat(new_form.astype(np.int64), heads) > 1) | np.logical_or.reduceat(f == _SEVERAL, heads)
    least = d[np.flatnonzero(new_form)][np.cumsum(new_form) - 1]
    dup, several = np.zeros(len(k), bool), np.zeros(len(k), bool)
    dup[order] = (d > least) & (f != _SEVERAL)
    several[order] = many[np.cumsum(new_key) - 1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    pack = lambda x: [np.packbits(x[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table(
        {"kind": columns["kind"], "batch": columns["batch"], "bucket": columns["bucket"], "dup": pack(dup), "several": pack(several) if kind == 0 else [b""] * len(sizes)},
        schema=_ANSWER
    )


def _bits(answers: pa.Table, kind: int, column: str, entries: _Entries) -> np.ndarray:
    out = np.zeros(len(entries.keys), bool)
    for k, bucket, packed in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", column))):
        if k == kind:
            a, b = entries.bounds[bucket], entries.bounds[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(b - a)).astype(bool)
    return out


def removed_runs(batch: Batch, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The removed runs of a batch, from all answers to it."""
    batch.decide(_bits(answers, 0, "dup", batch.entries), _bits(answers, 0, "several", batch.entries))
    return batch.removed(_bits(answers, 1, "dup", batch.suffixes()))


def digest(batch: Batch, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every document of a batch."""
    docs, begins, ends = runs
    edges = np.searchsorted(docs, np.arange(len(batch.docs) + 1))
    view, removed, shas = memoryview(batch.data), [], []
    for i in range(len(batch.docs)):
        sha, at, gone = hashlib.sha256(), int(batch.offsets[i]), 0
        for b, e in zip(begins[edges[i] : edges[i + 1]].tolist(), ends[edges[i] : edges[i + 1]].tolist()):
            sha.update(view[at:b])
            gone, at = gone + e - b, e
        sha.update(view[at : int(batch.offsets[i + 1])])
        removed.append(gone)
        shas.append(sha.hexdigest())
    return pa.table(
        [batch.ids, pa.array(np.diff(batch.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(shas, pa.string())],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    )


DIGEST_DDL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remaining(batch: Batch, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """``id``, the kept bytes and the removed spans of every document of a batch."""
    docs, begins, ends = runs
    edges = np.searchsorted(docs, np.arange(len(batch.docs) + 1))
    kept, spans, data = [], [], batch.data.tobytes()
    for i in range(len(batch.docs)):
        base = at = int(batch.offsets[i])
        out, own = [], []
        for b, e in zip(begins[edges[i] : edges[i + 1]].tolist(), ends[edges[i] : edges[i + 1]].tolist()):
            out.append(data[at:b])
            own.append({"begin": b - base, "end": e - base})
            at = e
        kept.append(b"".join([*out, data[at : int(batch.offsets[i + 1])]]))
        spans.append(own)
    return pa.table(
        [batch.ids, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
        names=["id", "kept", "spans"]
    )


REMAINING_DDL = "id long, kept binary, spans array<struct<begin: long, end: long>>"


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, width: int = WIDTH,
    finish=remaining, finish_ddl: str = REMAINING_DDL, batch_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per row of ``docs``: its id and what ``finish`` makes of its removed runs.

    The text is dealt to batches once and that exchange is read by the three passes over it;
    besides, only entries of some 14 bytes a phrase and bits are shuffled.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(partitions, -(-total // batch_bytes))
    buckets = max(partitions, -(-total // (2 * batch_bytes)))
    # Rows that share an id, or have none, are dealt by their texts.
    dealt = own.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(5), "text"), F.lit(batches)).cast("int"))

    def phrases(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        batch = Batch(table, buckets, span, width)
        return _sent(key[0].as_py(), batch.entries, 0)

    def suffixes(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SENT.empty_table()
        batch = Batch(table, buckets, span, width)
        batch.decide(_bits(answers, 0, "dup", batch.entries), _bits(answers, 0, "several", batch.entries))
        return _sent(key[0].as_py(), batch.suffixes(), 1)

    def finished(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, buckets, span, width)
        return finish(batch, removed_runs(batch, answers))

    by_batch = dealt.groupBy("batch")
    on_phrases = by_batch.applyInArrow(phrases, _SENT_DDL).groupBy("bucket").applyInArrow(answer, _ANSWER_DDL)
    on_suffixes = by_batch.cogroup(on_phrases.groupBy("batch")).applyInArrow(suffixes, _SENT_DDL).groupBy("bucket").applyInArrow(answer, _ANSWER_DDL)
    out = by_batch.cogroup(on_phrases.unionByName(on_suffixes).groupBy("batch")).applyInArrow(finished, finish_ddl)
    return out.withColumnRenamed("id", id_column)
