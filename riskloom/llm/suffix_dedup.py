"""Suffix-array deduplication: removing byte strings that an earlier document holds.

A window is a string of ``WINDOW`` bytes. Every window is owned by the least hash of the short
strings in it, which depends on its content alone, so equal windows have equal owners. One pass
finds owners that two documents share; a bitmap of them, of bounded size, lets a second pass
send only the text around shared owners to the tasks that sort it (a wrong hit in the bitmap
costs a row and changes nothing).

Each task sorts the suffixes of its texts in two stages: suffixes smaller than their successors
are sorted directly, the rest are induced by a scan of the buckets of first bytes. Common
prefixes of adjacent suffixes then show the windows that are equal. Owners with very many rows
are dealt over several tasks; of each class of equal windows a task then passes on its earliest
member only, and the classes of all tasks are merged by a group-by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import as_bytes, only, portions, slices
from riskloom.session import settle, shuffles_dropped

WINDOW = 50
GRAM = 16  # bytes whose hashes compete for a window
MOST_WINDOWS = 64  # windows in one row, whatever the text repeats
BITMAP = (1 << 20, 1 << 28)  # bits
PARTS = 64  # slices of the bitmap, at least
HOT = 256  # weight from which an owner is dealt out
HOTTEST = 4096  # owners that can be that hot
BLOCK_BYTES = 1 << 17  # text that is hashed at once, which suits a processor's cache
BATCH_BYTES = 400_000  # text that is sorted at once, and more only where one owner has more
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_LAST = (1 << 63) - 1  # stands for a null id, which comes after all others


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (8 or more) bytes from each place on."""
    n = len(text) - gram + 1
    out = np.ndarray((n,), np.uint64, text, 0, (1,)) * _MIX
    for at in range(8, gram, 8):
        out ^= out >> np.uint64(32)
        out += np.ndarray((n,), np.uint64, text, min(at, gram - 8), (1,))  # the last word may overlap the one before
        out *= _MIX
    out ^= out >> np.uint64(29)
    out *= _MIX2
    return out


def owners(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one owner: (owner, text number, first window, number of windows)."""
    none = np.zeros(0, np.int64)
    whole = b"".join(texts)
    n = len(whole) - window + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    least, have, wide = gram_hashes(whole, gram), 1, window - gram + 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[wide - have :][:n]) if have < wide else least[:n]
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    starts = np.unique(np.concatenate([first[first < n], np.flatnonzero(least[1:] != least[:-1]) + 1]))
    doc = np.searchsorted(first, starts, "right") - 1  # of texts that start together, only the last has bytes
    stop = np.minimum(np.append(starts[1:], n), first[doc] + sizes[doc] - window + 1)  # no window crosses into the next text
    good = stop > starts
    run, doc, stop = starts[good], doc[good], stop[good]
    many = -(-(stop - run) // MOST_WINDOWS)  # very long runs are cut
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start, doc = np.repeat(run, many) + part * MOST_WINDOWS, np.repeat(doc, many)
    owner = least[start]  # least hashes crowd at the low end, so they are mixed once more
    owner ^= owner >> np.uint64(32)
    owner *= _MIX
    owner ^= owner >> np.uint64(29)
    return owner, doc, start - first[doc], np.minimum(np.repeat(stop, many) - start, MOST_WINDOWS)


def _announce(window: int, gram: int, parts: int):
    """One row per owner and block of documents; owners of several documents weigh more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 4096):
            raw = as_bytes(batch.column("text"))
            seen, held = [], []
            for lo, hi in slices(raw, BLOCK_BYTES):
                owner, doc, _, _ = owners(raw[lo:hi], window, gram)
                order = np.lexsort((doc, owner))
                owner, doc = owner[order], doc[order]
                once = np.ones(len(owner), bool)
                once[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
                seen.append(owner[once])
            every = np.sort(np.concatenate([np.zeros(0, np.uint64), *seen]))
            held, count = np.unique(every, return_counts=True)
            rows = np.repeat(held, np.where(count > 1, 2 + count // 64, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows.view(np.int64))], names=["owner"])

    return run


def _merge_slices(parts_bits: int, bits: int, hot: int):
    """Per slice of the owners: the bitmap of shared ones and the hot ones with their weight."""
    low, width = bits - parts_bits, 1 << (bits - parts_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("owner").to_numpy().view(np.uint64) for b in batches]
        every = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        owner, count = np.unique(every, return_counts=True)
        piece = owner >> np.uint64(64 - parts_bits)
        for p in np.unique(piece).tolist():
            mine = piece == p
            shared = mine & (count > 1)
            slot = (owner[shared] >> np.uint64(64 - bits)) & np.uint64(width - 1)
            flags = np.zeros(width, bool)
            flags[slot.astype(np.int64)] = True
            top = mine & (count > hot)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([owner[top].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([count[top].tolist()], pa.list_(pa.int64()))],
                names=["part", "bits", "hot", "weight"])

    return run


class Shared:
    """Which owners may be shared, and over how many tasks the hot ones are dealt."""

    def __init__(self, bits: int, bitmap: np.ndarray, hot: dict[int, int]):
        self.bits, self.bitmap = bits, bitmap
        self.hot = np.array(sorted(hot), np.uint64)
        self.deal = np.array([hot[h] for h in sorted(hot)], np.int64)

    def may_be(self, owner: np.ndarray) -> np.ndarray:
        slot = (owner >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def tasks(self, owner: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(owner), np.int64)
        at = np.minimum(np.searchsorted(self.hot, owner), len(self.hot) - 1)
        return np.where(self.hot[at] == owner, self.deal[at], 1)


def _send(shared, window: int, gram: int):
    """The text of each run of windows whose owner may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = shared.value
        for batch in portions(batches):
            raw = as_bytes(batch.column("text"))
            doc_id = np.array([_LAST if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
            for lo, hi in slices(raw, BLOCK_BYTES):
                owner, doc, start, size = owners(raw[lo:hi], window, gram)
                some = own.may_be(owner)
                owner, doc, start, size = owner[some], doc[some], start[some], size[some]
                check = np.array([xxhash.xxh32_intdigest(x) for x in raw[lo:hi]], np.int64)
                deal = own.tasks(owner)
                salt = np.where(deal > 1, (doc_id[lo + doc].view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % deal + 1, 0)
                body = [raw[lo + d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), (size + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((owner >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(salt.astype(np.int32)), pa.array(doc_id[lo + doc]), pa.array(check[doc]), pa.array(start), pa.array(body, pa.binary())],
                    names=["owner", "salt", "doc_id", "check", "start", "body"])

    return run


_SENT = "owner int, salt int, doc_id long, check long, start long, body binary"
_SHIFT = bytes(min(b, 254) + 1 for b in range(256))  # leaves 0 for the end of a text


def words_at(text: bytes, at: np.ndarray, offset: int) -> np.ndarray:
    """The eight bytes from ``at + offset`` as a big-endian number."""
    return np.ndarray((len(text) - 7 - offset,), ">u8", text, offset, (1,))[at].astype(np.uint64)


def direct_order(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes from there, ties in any order."""
    order = at[np.argsort(words_at(text, at, 0), kind="stable")]
    first = words_at(text, order, 0)
    group = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]])) if len(order) else first
    for offset in range(8, depth, 8):
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        word = words_at(text, order[tied], offset)
        new = np.lexsort((word, group[tied]))
        order[tied], word, g = order[tied[new]], word[new], group[tied]
        split = np.concatenate([[False], (word[1:] != word[:-1]) & (g[1:] == g[:-1])])
        step = np.zeros(len(order) + 1, np.int64)
        step[tied[split]] = 1
        step[1:-1][np.asarray(group[1:] != group[:-1])] = 1
        group = np.cumsum(step[:-1])
    return order


def two_stage_order(text: bytes, depth: int) -> np.ndarray:
    """All places of ``text`` in the order of their suffixes (by ``depth`` bytes at least).

    ``text`` ends with eight zeros per word of ``depth``; a zero ends each part of it. Suffixes
    smaller than their successors are sorted directly. Then buckets of first bytes are scanned
    upwards: a suffix larger than its successor follows the order of that successor, which is
    known by then, and stands before the directly sorted ones of its bucket.
    """
    n = len(text) - depth - 8
    c = np.frombuffer(text, np.uint8)[: n + 1].astype(np.int64)
    change = np.flatnonzero(c[1:] != c[:-1]) + 1
    after = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")]  # the next other byte
    rising = c[after] > c[:n]
    end = c[:n] == 0
    rank = np.zeros(n + 1, np.int64)
    ends = np.flatnonzero(end)
    rank[ends], done = np.arange(len(ends)), len(ends)
    rank[n] = 0
    b = direct_order(text, np.flatnonzero(rising & ~end), depth)
    b_byte = c[b]
    a = np.flatnonzero(~rising & ~end)
    level = after[a] - a
    order = np.lexsort((level, c[a]))
    a, level = a[order], level[order]
    a_byte = c[a]
    cuts = np.flatnonzero((a_byte[1:] != a_byte[:-1]) | (level[1:] != level[:-1])) + 1 if len(a) else np.zeros(0, np.int64)
    a_parts = np.split(a, cuts) if len(a) else []
    pieces, k = [ends], 0
    b_edges = np.searchsorted(b_byte, np.arange(257))
    for byte in range(1, 256):
        while k < len(a_parts) and c[a_parts[k][0]] == byte:  # by the length of the run of this byte
            part = a_parts[k][np.argsort(rank[a_parts[k] + 1], kind="stable")]
            rank[part] = np.arange(done, done + len(part))
            done += len(part)
            pieces.append(part)
            k += 1
        part = b[b_edges[byte] : b_edges[byte + 1]]
        rank[part] = np.arange(done, done + len(part))
        done += len(part)
        pieces.append(part)
    return np.concatenate(pieces)


def equal_windows(bodies: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, class) of every window, classes of equal windows numbered along the suffix order."""
    depth = -(-window // 8) * 8
    text = b"\x00".join([x.translate(_SHIFT) for x in bodies] + [b""]) + bytes(depth + 8)
    raw = b"\x00".join([*bodies, b""]) + bytes(depth + 8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    body = np.repeat(np.arange(len(bodies)), sizes + 1)
    start = np.arange(len(body)) - first[body]
    order = two_stage_order(text, depth)
    order = order[start[order] <= sizes[body[order]] - window]
    same = np.ones(max(len(order) - 1, 0), bool)
    for offset in [*range(0, window - 7, 8), window - 8]:  # common prefixes of neighbours, as far as they matter
        word = words_at(raw, order, offset)
        same &= word[1:] == word[:-1]
    number = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    return body[order], start[order], number


def _judge(window: int):
    def judged(owner: np.ndarray, salted: np.ndarray, doc: np.ndarray, check: np.ndarray, at: np.ndarray, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        number = np.fromiter([known.setdefault(x, len(known)) for x in bodies], np.int64, len(bodies))
        distinct = list(known)
        least = np.full(len(distinct), _LAST, np.int64)
        np.minimum.at(least, number, doc)
        sizes = np.array([len(x) for x in distinct], np.int64)
        # whole repeats of the same text go at once; members of the earliest document share a verdict
        later = doc > least[number]
        yield _rows(doc[later], check[later], at[later], at[later] + sizes[number[later]], None)
        # a text can only share windows with others of its owner
        of = np.zeros(len(distinct), np.int64)
        of[number] = owner
        value, place, many = np.unique(of, return_inverse=True, return_counts=True)
        any_salt = np.zeros(len(distinct), bool)
        any_salt[number] = salted
        chosen = np.flatnonzero((many[place] > 1) | any_salt)
        if not len(chosen):
            return
        body, start, group = equal_windows([distinct[i] for i in chosen], window)
        body = chosen[body]
        first = np.full(int(group.max(initial=-1)) + 1, _LAST, np.int64)
        np.minimum.at(first, group, least[body])
        gone = least[body] > first[group]
        follow = np.flatnonzero(~later)
        follow = follow[np.argsort(number[follow], kind="stable")]
        edges = np.searchsorted(number[follow], np.arange(len(distinct) + 1))

        def members(texts: np.ndarray, begin: np.ndarray, stop: np.ndarray, which: np.ndarray | None) -> pa.RecordBatch:
            many = edges[texts + 1] - edges[texts]
            row = follow[np.repeat(edges[texts] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            windows = None if which is None else [distinct[t][b : b + window] for t, b in zip(np.repeat(texts, many).tolist(), np.repeat(begin, many).tolist())]
            return _rows(doc[row], check[row], at[row] + np.repeat(begin, many), at[row] + np.repeat(stop, many), windows)

        order = np.lexsort((start[gone], body[gone]))
        b, s = body[gone][order], start[gone][order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(b)) - 1
        if len(begin):
            yield members(b[begin], s[begin], s[stop] + window, None)
        open_ = ~gone & any_salt[body]  # earliest of this task, perhaps not of all
        if open_.any():
            yield members(body[open_], start[open_], start[open_] + window, np.ones(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], [], []]
        held = 0
        names = ["owner", "salt", "doc_id", "check", "start", "body"]

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal columns, held
            owner = np.concatenate([np.zeros(0, np.int64), *columns[0]])
            keep = 0 if whole else int((owner != owner[-1]).nonzero()[0][-1]) + 1 if len(owner) and (owner != owner[-1]).any() else 0
            stop = len(owner) if whole else keep
            rest = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns[1:5]]
            bodies = columns[5]
            if stop:
                yield from judged(owner[:stop], rest[0][:stop] > 0, rest[1][:stop], rest[2][:stop], rest[3][:stop], bodies[:stop])
            columns = [[owner[stop:]], *[[x[stop:]] for x in rest], bodies[stop:]]
            held = sum(map(len, columns[5]))

        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                for i, name in enumerate(names[:5]):
                    columns[i].append(part.column(name).to_numpy().astype(np.int64))
                bodies = part.column("body").to_pylist()
                columns[5] = columns[5] + bodies
                held += sum(map(len, bodies))
                if held > BATCH_BYTES:
                    yield from flush(False)
        yield from flush(True)

    return run


_REMOVED = "doc_id long, check long, start long, stop long, repeated binary"


def _rows(doc: np.ndarray, check: np.ndarray, start: np.ndarray, stop: np.ndarray, windows: list[bytes] | None) -> pa.RecordBatch:
    last = pa.nulls(len(doc), pa.binary()) if windows is None else pa.array(windows, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(check), pa.array(start), pa.array(stop), last], names=["doc_id", "check", "start", "stop", "repeated"])


def shared_owners(texts: DataFrame, window: int, gram: int) -> Shared:
    """One pass that finds the owners two documents share; what reaches the driver is bounded."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max((total // 4).bit_length(), BITMAP[0].bit_length() - 1), BITMAP[1].bit_length() - 1)
    parts = max(PARTS, min(8192, total // (32 << 20)))
    parts_bits = (parts - 1).bit_length()
    hot = max(HOT, total // 16 // HOTTEST)
    told = texts.select("text").mapInArrow(_announce(window, gram, parts), "owner long")
    dealt = told.repartition(1 << parts_bits, F.shiftrightunsigned("owner", 64 - parts_bits))
    with shuffles_dropped(spark):
        found = dealt.mapInArrow(_merge_slices(parts_bits, bits, hot), "part long, bits binary, hot array<long>, weight array<long>").collect()
    width = (1 << bits >> parts_bits) // 8
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    deal: dict[int, int] = {}
    for r in found:
        bitmap[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
        deal |= {h & ((1 << 64) - 1): -(-w // hot) for h, w in zip(r["hot"], r["weight"])}
    return Shared(bits, bitmap, deal)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, check, start, stop): byte ranges, perhaps overlapping, that windows of earlier
    documents cover. ``check`` is a hash of the text the range belongs to."""
    spark = docs.sparkSession
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = spark.sparkContext.broadcast(shared_owners(texts, window, gram))
    sent = texts.mapInArrow(_send(shared, window, gram), _SENT)
    # Owners spread by their hash; a hot one by its salt as well.
    dealt = sent.repartition(F.col("owner"), F.col("salt")).sortWithinPartitions("owner", "salt")
    judged = settle(dealt.mapInArrow(_judge(window), _REMOVED), "suffix-judged")
    done, open_ = judged.filter("repeated is null"), judged.filter("repeated is not null")
    first = open_.groupBy("repeated").agg(F.min("doc_id").alias("first"))
    late = open_.join(first, "repeated").filter("doc_id > first")
    return done.select("doc_id", "check", "start", "stop").unionByName(late.select("doc_id", "check", "start", "stop"))


def _cut_out(keep_text: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for raw, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["stop"]) for x in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                done, kept = 0, []
                for start, stop in merged:
                    kept.append(raw[done:start])
                    done = stop
                kept = b"".join([*kept, raw[done:]])
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(kept))
                n_spans.append(len(merged))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in portions(batches):
        check = pa.array([xxhash.xxh32_intdigest(x) for x in as_bytes(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), check, batch.column("text")], names=["doc_id", "check", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and, with ``keep_text``, the remaining bytes as ``kept``.

    Every byte covered by a string of ``window`` bytes that also starts in a document with a
    smaller id is removed; strings are judged on the input. Null and empty texts have nothing
    to remove, shorter texts than a window neither. Rows with the same id remove nothing from
    each other; rows with a null id come last and neither do they.
    """
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = repeated_spans(docs, id_col, text_col, window, gram)
    per_doc = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("check").alias("_check")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    checked = texts.mapInArrow(_checked, "doc_id long, check long, text string")
    joined = checked.join(per_doc, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_doc")) & (F.col("check") == F.col("_check")), "left")
    done = joined.select("doc_id", "text", "spans").mapInArrow(_cut_out(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")
