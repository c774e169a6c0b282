"""Best-fit packing of tokenized documents into sequences by bin completion.

Documents are tokenized (plus an end-of-document id), cut into pieces of at
most ``capacity`` tokens, and the pieces are packed into as few sequences as
possible.  The search is a branch and bound over bin completions: the largest
unplaced piece opens a sequence, the undominated sets of pieces that may fill
it up are tried in order of waste, a branch is pruned when its waste exceeds
what the best known solution leaves, and best-fit packings are the incumbents.

At scale only lengths are packed, in salted groups of bounded size; the
weakest sequences of the groups are packed again in further rounds until one
group is left, so the whole loses less than one sequence per final group.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stage, table

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
PER_GROUP = 8_192           # pieces packed together by one task
NODES = 20_000              # branch-and-bound nodes per group
WORDS_CACHED = 150_000      # entries per generation of the caches of one worker


# ------------------------------------------------------------------ tokens

def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    are the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


class WordTokens:
    """Ids of a text, tokenized word by word with bounded caches.

    White space is dropped by this vocabulary and no token spans it, so the
    ids of a text are those of its words in order.  Words of ASCII and Latin-1
    letters, digits and signs are normalised and split here by the rules the
    vocabulary file states (lower case; letters, single digits, runs of signs,
    English contractions), and each part goes to its BPE model; all other
    words, and any that may hold a special token, take the whole tokenizer in
    one call.  A text of nothing but the former is split into parts as a whole:
    its parts are far fewer than its words with their signs and capitals.
    ``dtype`` is the packed id type.
    """

    SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:[stmd]|re|ve|ll)"
                       "|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9 \t-\r]+")
    OTHER = re.compile("[^!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff \t-\r]")

    def __init__(self, vocabulary: str, dtype: str = "<u4"):
        import public_tokenizers
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.dtype = dtype
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.alphabet = _byte_characters()

    def _part(self, part: str) -> bytes:
        if len(self.parts) > WORDS_CACHED:
            self.parts.clear()
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = self.parts[part] = b"".join(
            t.id.to_bytes(int(self.dtype[2]), "little") for t in self.model.model.tokenize(text))
        return ids

    def _learn(self, missing: list[bytes]) -> None:
        import numpy as np
        rest = []
        for w in missing:
            word = w.decode("utf-8", "replace")
            if self.SIMPLE.fullmatch(word) and "<|" not in word:
                self.young[w] = b"".join([self.parts.get(p) or self._part(p)
                                          for p in self.PARTS.findall(word.lower())])
            else:
                rest.append((w, word))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            enc = self.model.encode([word for _, word in part], is_pretokenized=True,
                                    add_special_tokens=False)
            ids = np.array(enc.ids, self.dtype)
            owner = np.array([-1 if i is None else i for i in enc.word_ids], np.int64)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for k, (w, _) in enumerate(part):
                self.young[w] = ids[bounds[k]:bounds[k + 1]].tobytes()

    def packed(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed little-endian ids of each text (UTF-8 bytes)."""
        for text in texts:
            whole = text.decode("utf-8", "replace")
            if "<|" not in whole and not self.OTHER.search(whole):
                parts = self.PARTS.findall(whole.lower())
                known, ids = self.parts, {}
                for p in set(parts):
                    ids[p] = known.get(p) or self._part(p)
                    known = self.parts
                yield b"".join(map(ids.__getitem__, parts))
                continue
            words = text.split()
            if len(self.young) > WORDS_CACHED:
                self.old, self.young = self.young, {}
            young, old = self.young, self.old
            missing = []
            for w in set(words):
                if w not in young:
                    if w in old:
                        young[w] = old[w]
                    else:
                        missing.append(w)
            if missing:
                self._learn(missing)
            yield b"".join(map(young.__getitem__, words))


_TOKENIZERS: dict[tuple, WordTokens] = {}


def word_tokens(vocabulary: str, dtype: str = "<u4") -> WordTokens:
    """The tokenizer of this worker process (kept between tasks)."""
    key = (vocabulary, dtype)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokens(vocabulary, dtype)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, salt`` of every document.

    ``salt`` deals the pieces into groups; it differs between equal rows.
    """
    arrow_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        tokens = word_tokens(vocabulary)
        serial = 0
        for batch in batches:
            rows = []
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.packed(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    crc = zlib.crc32(part)
                    serial += 1
                    mixed = zlib.crc32(f"{doc}|{piece}|{serial}".encode(), crc)
                    rows.append((doc, piece, at // 4, len(part) // 4, crc, mixed))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


# ----------------------------------------------------------------- packing

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices per bin."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []            # (space left, bin), sorted
    for i in order:
        k = bisect_left(room, (lengths[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= lengths[i]
        if left:
            entry = (left, b)
            room.insert(bisect_left(room, entry), entry)
    return bins


def completions(count: list[int], sizes: list[int], room: int, width: int = 24) -> list[tuple[int, ...]]:
    """The most promising fillings of ``room`` from the multiset ``count`` by waste.

    At most ``width`` first pieces, and for each as many second ones that leave
    a perfect third, are looked at (``every_completion`` has all).  One, two or three sizes, largest first; what then still fits is filled
    greedily.  A filling is dominated when another of no more pieces uses at
    least as much of the room with pieces that are larger one by one, so for
    a chosen prefix only the largest last piece is tried.
    """
    def largest(limit: int, used: tuple[int, ...]) -> int:
        k = bisect_left(sizes, limit + 1) - 1
        while k >= 0:
            s = sizes[k]
            if count[s] > used.count(s):
                return s
            k -= 1
        return 0

    def greedy(fill: tuple[int, ...], left: int) -> tuple[int, ...]:
        while left:
            s = largest(left, fill)
            if not s:
                break
            fill += (s,)
            left -= s
        return fill

    found: dict[tuple[int, ...], int] = {}
    one = largest(room, ())
    if not one:
        return [()]
    first = bisect_left(sizes, one + 1) - 1
    tried = 0
    while first >= 0 and tried < width:
        a = sizes[first]
        first -= 1
        tried += 1
        left = room - a
        b = largest(left, (a,)) if left else 0
        if b and b <= a:
            fill = greedy((a, b), left - b)
        else:
            fill = greedy((a,), left) if not b or b > a else (a,)
        found.setdefault(tuple(sorted(fill, reverse=True)), room - sum(fill))
        if left and room - sum(fill):
            k, more = bisect_left(sizes, min(a, left)), 0    # a second piece that leaves a perfect third
            while k > 0 and more < width:
                k -= 1
                b2 = sizes[k]
                if count[b2] <= (b2 == a):
                    continue
                more += 1
                c = left - b2
                if c and c <= b2 and c < len(count) and count[c] > (a == c) + (b2 == c):
                    found.setdefault((a, b2, c), 0)
                    break
        if any(w == 0 for w in found.values()) and tried >= 4:
            break
    return sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))


def every_completion(count: list[int], sizes: list[int], room: int) -> Iterator[tuple[int, ...] | None]:
    """All fillings of ``room`` to which no piece left can be added, lazily and
    largest pieces first; None for a dead end (a piece passed over still fits)."""
    stock = [s for s in reversed(sizes) if s <= room]
    free = [count[s] for s in stock]
    ascending = stock[::-1]
    fill: list[int] = []                                  # places in ``stock``
    at, left, n = 0, room, len(stock)
    while True:
        grown = not fill and at == 0
        while True:
            at = max(at, n - bisect_left(ascending, left + 1))
            while at < n and not free[at]:
                at += 1
            if at >= n:
                break
            fill.append(at)
            free[at] -= 1
            left -= stock[at]
            grown = True
        if grown:
            least = next((stock[k] for k in range(n - 1, -1, -1) if free[k]), room + 1)
            yield None if least <= left else tuple(stock[k] for k in fill)
        if not fill:
            return
        at = fill.pop()
        free[at] += 1
        left += stock[at]
        at += 1


def bin_completion(lengths: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Pack ``lengths`` into few bins: branch and bound over bin completions.

    Best-fit decreasing is the first incumbent; it is returned at once when it
    meets the lower bound ``ceil(sum / capacity)``.  Else depth-first search:
    the largest piece left opens a bin, its completions are tried by waste,
    and a branch whose waste exceeds what an improved solution may lose is
    pruned.  The first search takes the promising completions of each bin; when
    it is exhausted, a second one takes all, so that its end is a proof.
    ``nodes`` bounds both together; the incumbent is then returned, so every
    piece is always placed.
    """
    incumbent = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = -(-total // capacity)
    if len(incumbent) <= bound or not lengths:
        return incumbent
    count = [0] * (capacity + 1)
    for x in lengths:
        count[x] += 1
    sizes = [s for s in range(1, capacity + 1) if count[s]]
    best: list[tuple[int, ...]] | None = None
    best_n = len(incumbent)
    # one frame per bin: (pieces of the bin, options left, waste before)
    chosen: list[tuple[int, ...]] = []
    options: list[Iterator[tuple[int, ...] | None]] = []
    wastes = [0]
    placed = 0
    visited = 0

    def take(fill):                                       # ``sizes`` lists the sizes left
        for s in fill:
            count[s] -= 1
            if not count[s]:
                del sizes[bisect_left(sizes, s)]

    def give(fill):
        for s in fill:
            if not count[s]:
                insort(sizes, s)
            count[s] += 1

    def open_bin():
        if not sizes:
            return None
        top = sizes[-1]
        take((top,))
        fills = fillings(count.copy(), sizes.copy(), capacity - top)
        give((top,))
        return ((top, *f) if f is not None else None for f in fills)

    ended = False
    for fillings in (completions, every_completion):
        frame = open_bin()
        while frame is not None:
            options.append(frame)
            frame = None
            while options:
                allowed = (best_n - 1) * capacity - total     # waste an improvement may have
                if visited >= nodes or allowed < 0:
                    ended = True
                    options.clear()
                    break
                if len(chosen) == len(options):               # back at this bin: undo its filling
                    fill = chosen.pop()
                    give(fill)
                    placed -= sum(fill)
                    wastes.pop()
                fill = next(options[-1], ())
                if fill == ():
                    options.pop()
                    continue
                if fill is None:
                    visited += 1
                    continue
                waste = wastes[-1] + capacity - sum(fill)
                visited += 1
                last = placed + sum(fill) == total            # the last bin may stay part empty
                if (waste - (capacity - sum(fill)) if last else waste) > allowed \
                        or len(chosen) + 1 >= best_n:
                    continue
                take(fill)
                chosen.append(fill)
                placed += sum(fill)
                wastes.append(waste)
                if last:
                    best, best_n = list(chosen), len(chosen)
                    if best_n <= bound:
                        ended = True
                        options.clear()
                        break
                    continue
                frame = open_bin()
                break
            if not options:
                break
        if ended:
            break
    if best is None:
        return incumbent
    stock: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        stock.setdefault(x, []).append(i)
    return [[stock[s].pop() for s in fill] for fill in best]


def _round(rows: DataFrame, groups: int, capacity: int, nodes: int) -> DataFrame:
    """Pack each salted group; adds ``bin`` (number in the group), ``offset``
    and ``weak`` (the fullest bins are final, the weakest goes on)."""

    def pack(t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_pylist()
        packed = bin_completion(lengths, capacity, nodes)
        number, offset = [0] * len(lengths), [0] * len(lengths)
        fills = []
        for b, members in enumerate(packed):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += lengths[i]
            fills.append(at)
        slack = [b for b in sorted(range(len(fills)), key=lambda b: fills[b])
                 if fills[b] < capacity][:max(1, len(fills) // 64)]
        slack = set(slack)
        return (t.append_column("bin", pa.array(number, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64()))
                .append_column("weak", pa.array([b in slack for b in number], pa.bool_())))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(
        pack, f"{schema}, grp bigint, bin bigint, offset bigint, weak boolean")


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP,
                nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces ``(..., length, salt)``.

    Full pieces are sequences of their own and never enter a group.  A round
    deals the rest into groups of about ``per_group`` pieces by their salt (no
    key of the data, so nothing is hot) and packs each; the weakest bins of
    all groups (a 64th, at least one) are emptied and packed in the next round,
    until one group is left.
    """
    full = rows.where(F.col("length") >= capacity).select(
        "*", F.lit(0).cast("long").alias("round"), F.lit(-1).cast("long").alias("grp"),
        F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"))
    open_rows = rows.where(F.col("length") < capacity)
    parts, level, before = [full], 1, None
    while True:
        n = open_rows.count()
        groups = max(1, -(-n // per_group))
        done = stage(_round(open_rows, groups, capacity, nodes))
        final = groups == 1 or (before is not None and groups >= before)
        keep = done if final else done.where(~F.col("weak"))
        parts.append(keep.drop("weak").withColumn("round", F.lit(level).cast("long"))
                     .select(full.columns))
        if final:
            break
        open_rows = done.where(F.col("weak")).drop("grp", "bin", "offset", "weak")
        level, before = level + 1, groups
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # round, group and bin in one number: 2**20 bins per group, 2**38 groups, 32 rounds
    sequence = F.when(F.col("grp") < 0, -F.col("bin") - 1).otherwise(
        F.col("round") * F.lit(1 << 58) + F.col("grp") * F.lit(1 << 20) + F.col("bin"))
    return out.withColumn("sequence_id", sequence).drop("round", "grp", "bin", "salt")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
                   end_id: int = END_ID) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` with their place in a sequence:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Shape: one pass over the texts writes a narrow table of pieces; only that
    is dealt into groups.  Lengths are at most ``capacity``, groups have a
    bounded number of pieces, and a bin takes the number of its group, so
    sequence ids need no further pass.

    Edge cases: null or empty text is the end id alone (a piece of length 1);
    a null doc_id and repeated rows are packed like any row (a piece per row);
    only texts longer than ``capacity`` are cut, the last piece may be shorter;
    an empty table gives an empty result; extra columns do not take part.
    """
    rows = stage(pieces(docs, capacity, end_id, vocabulary))
    return pack_pieces(rows, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
