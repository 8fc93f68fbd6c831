"""BPE encoding and decoding as bounded-lookahead transducers.

A merge list fixes how far to the right of a position its fate can depend on: ``sufficient_lookahead``
computes that number of bytes. The encoder reads every pre-token in windows, and emits the tokens that end that
far before the window's end; nothing that follows can change them. A window that reaches the pre-token's end is stable as a
whole. Many pre-tokens go through this together, one window of each at a time, and of equal ones (compared by their
bytes) one does. A long text is read in blocks of characters, and what the next characters may still change is carried over:
three characters, or an open pre-token's window. So working memory is a block, however long a text or a pre-token is. The
decoder turns bytes into text with a state machine that holds back at most three bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrays import lane_hashes, lanes, spread, tidy

#: The byte-level scheme's pre-token pattern, and the printable stand-ins for bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Bytes of a window beyond the lookahead, and bytes up to which windows are merged side by side in arrays.
WINDOW, SIDE = 2048, 256
#: Characters of a block, and how many at its end the next ones may bear on.
BLOCK, HELD = 500_000, 3
#: A character of each class that starts no contraction.
LIKE = "\na1!"


def byte_of_char() -> dict[str, int]:
    table, spare = {chr(b): b for b in PRINTABLE}, 256
    for b in range(256):
        if b not in PRINTABLE:
            table[chr(spare)] = b
            spare += 1
    return table


def sufficient_lookahead(merges: Iterable[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a boundary that decide whether it lasts, for merges (left, right, result) by rank.

    A rule with right part v removes the boundary before v unless an earlier rule takes v's end away, and
    that rule's left part must then be a token ending where v ends: one on the right spine of v's own
    derivation. So a rule reaches len(v) further than the furthest earlier rule whose left part lies on
    that spine, and the list's lookahead is the furthest reach of any rule.
    """
    reach_from: dict[int, int] = {}  # the furthest reach so far of rules by left part
    last_part: dict[int, int] = {}
    furthest = 0
    for left, right, result in merges:
        spine, beyond = right, 0
        while spine is not None:
            beyond = max(beyond, reach_from.get(spine, 0))
            spine = last_part.get(spine)
        reach = length[right] + beyond
        reach_from[left] = max(reach_from.get(left, 0), reach)
        last_part[result] = right
        furthest = max(furthest, reach)
    return furthest


class Merges:
    """A byte-level BPE vocabulary, its merges and their lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_of_char()
        as_bytes = lambda token: bytes(byte[c] for c in token)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in byte for c in k)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = dict(zip(vocab.values(), vocab.keys(), strict=True)) | {v: k.encode() for k, v in self.special.items()}
        self.start = [vocab.get(bytes([b])) for b in range(256)]
        rules = []
        for m in spec["model"]["merges"]:
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.rule = {(a << 20) | b: (rank << 20) | c for rank, (a, b, c) in enumerate(rules)}
        self.lookahead = sufficient_lookahead(rules, {i: len(t) for i, t in self.bytes_of.items()})
        self._flat = None
        self.width = max(map(len, self.bytes_of.values()))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, and by id where they start and how many they are."""
        if self._flat is None:
            n = max(self.bytes_of) + 1
            tokens = [self.bytes_of.get(i, b"") for i in range(n)]
            size = np.array([len(t) for t in tokens], np.int64)
            self._flat = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
        return self._flat

    def merge(self, ids: list[int]) -> list[int]:
        """Ids after all merges, lowest rule first, leftmost first; with a heap and links."""
        n, rule = len(ids), self.rule.get
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rule((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rule((ids[i] << 20) | ids[j]) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rule((ids[i] << 20) | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rule((ids[h] << 20) | ids[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids, a block of many texts at a time, with array operations over the block's characters.

    A block is cut into pre-tokens by character classes, equal pre-tokens go through the transducer once, and each block's
    ids are emitted before the next is read, so memory does not grow with a text or with the corpus.
    """

    def __init__(self, merges: Merges, window: int = WINDOW):
        self.merges, self.kind = merges, character_classes()
        self.window, self.size = max(window, merges.width), merges.flat()[2]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) + ")") if merges.special else None
        self.start = np.array(merges.start, np.int32)
        self.rules = PairTable(merges.rule)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end."""
        flat: list[np.ndarray] = []
        ends, special = [], self.merges.special
        if self.special and any(s in t for s in special for t in texts):
            total = 0
            for t in texts:
                for part in self.special.split(t):
                    got = np.array([special[part]], np.int32) if part in special else self._plain([part])[0]
                    flat.append(got)
                    total += len(got)
                ends.append(total)
            return np.concatenate(flat), np.array(ends, np.int64)
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text_ends = np.cumsum(lengths)
        starts = self._pretokens(chars, text_ends)
        out, upto = self._ids(whole, chars, starts, np.append(starts[1:], len(chars)))
        word_of_text_end = np.searchsorted(starts, text_ends)  # pre-tokens that start before a text's end
        return out, np.where(word_of_text_end > 0, upto[word_of_text_end - 1], 0)

    def _ids(self, whole: str, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens whole[start:end], which stand one after another, and how many there are up to each one's end."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(whole.encode(), np.uint8)
        wide = np.ones(len(chars), np.int8)
        wide += chars >= 0x80
        wide += chars >= 0x800
        wide += chars >= 0x10000
        at = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        lo, hi = at[starts], at[ends]
        first, which = self._equal(data, lo, hi)
        ids, count, _ = self._transduce(data, lo[first], hi[first])
        base = np.cumsum(count) - count
        each = count[which]
        return ids[spread(base[which], each)], np.cumsum(each)

    @staticmethod
    def _equal(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each set of equal pre-tokens, and by pre-token which: by a hash, and then by their bytes."""
        value, place, count = lanes(data, lo, hi)
        _, first, which = np.unique(lane_hashes(value, place, count, hi - lo), return_index=True, return_inverse=True)
        one, base = first[which], np.cumsum(count) - count
        differ = hi - lo != (hi - lo)[one]
        like = np.where(differ, 0, count)  # numbers compared
        off = value[spread(base, like)] != value[spread(base[one], like)]
        differ[np.repeat(np.arange(len(lo)), like)[off]] = True
        alone = np.flatnonzero(differ)  # of equal hash, but not equal: on their own
        which[alone] = len(first) + np.arange(len(alone))
        return np.concatenate((first, alone)), which

    def _transduce(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pre-tokens data[lo:hi], how many each has, and how far it has been read.

        All of them are read by windows at once; of each window what no byte behind it can change is emitted. Unless
        they have ``ended``, more bytes may follow, and what those may change is left.
        """
        at, live, ahead = lo.copy(), np.arange(len(lo)), self.merges.lookahead
        done_ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        done_run: list[np.ndarray] = [np.zeros(0, np.int64)]
        while len(live):
            stop = np.minimum(hi[live], at[live] + self.window + ahead)
            last = stop == hi[live]
            ids, run = self._merge(data, at[live], stop)
            upto = np.where(last & ended, stop, stop - ahead)
            size = self.size[ids]
            end = np.cumsum(size)
            before = np.concatenate(([0], end))[np.searchsorted(run, np.arange(len(live)))]
            stable = at[live][run] + end - before[run] <= upto[run]
            done_ids.append(ids[stable])
            done_run.append(live[run[stable]])
            at[live] += np.bincount(run[stable], size[stable], len(live)).astype(np.int64)
            live = live[~last]
        ids, run = np.concatenate(done_ids), np.concatenate(done_run)
        order = np.argsort(run, kind="stable")
        return ids[order], np.bincount(run, minlength=len(lo)), at

    def _pretokens(self, chars: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of PATTERN start."""
        n = len(chars)
        kind = self.kind[chars]
        fresh = np.zeros(n + 1, bool)  # where a text starts
        fresh[0] = fresh[n] = True
        fresh[text_ends] = True
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change |= fresh
        white = kind == 0
        cut = change[:n].copy()
        # the last white space before another character stands alone, or with that character if it is a space
        last = white.copy()
        last[:-1] &= ~white[1:]
        last &= ~fresh[1:]
        cut |= last
        joins = np.flatnonzero(last & (chars == 32)) + 1
        cut[joins] = False
        # contractions, where an apostrophe starts a pre-token
        for i in np.flatnonzero(cut & (chars == 39)).tolist():
            self._contraction(chars, fresh, cut, i)
        return np.flatnonzero(cut)

    @staticmethod
    def _contraction(chars: np.ndarray, fresh: np.ndarray, cut: np.ndarray, i: int) -> None:
        n = len(chars)
        while i < n and chars[i] == 39:
            nxt = chars[i + 1 : i + 3].tolist()
            if not nxt or fresh[i + 1]:
                return
            if nxt[0] in (115, 116, 109, 100):  # s t m d
                size = 2
            elif len(nxt) == 2 and not fresh[i + 2] and tuple(nxt) in ((114, 101), (118, 101), (108, 108)):  # re ve ll
                size = 3
            else:
                return
            cut[i + 1] = False
            i += size
            if i < n and not fresh[i]:
                # the rest of the letters starts anew; what follows is cut as before, unless a space was to join it
                cut[i] = True

    def _merge(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the windows data[lo:hi] and the window of each, in order; windows side by side take their lowest rule at once, again and again."""
        size = hi - lo
        long = size > SIDE
        done_ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        done_run: list[np.ndarray] = [np.zeros(0, np.int64)]
        for k in np.flatnonzero(long).tolist():
            got = np.array(self.merges.merge(self.start[data[lo[k] : hi[k]]].tolist()), np.int32)
            done_ids.append(got)
            done_run.append(np.full(len(got), k))
        short = np.flatnonzero(~long)
        ids = self.start[data[spread(lo[short], size[short])]]
        run = np.repeat(short, size[short])
        none = self.rules.none
        while len(ids):
            rule = np.full(len(ids), none)
            if len(ids) > 1:
                rule[:-1] = np.where(run[1:] == run[:-1], self.rules.find(ids[:-1], ids[1:]), none)
            begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            least = np.minimum.reduceat(rule, begin)
            lens = np.diff(np.append(begin, len(ids)))
            over = np.repeat(least == none, lens)
            if over.any():
                done_ids.append(ids[over])
                done_run.append(run[over])
                go = ~over
                live = least != none
                ids, run, rule, least, lens = ids[go], run[go], rule[go], least[live], lens[live]
                if not len(ids):
                    break
            hit = rule == np.repeat(least, lens)
            twice = np.flatnonzero(hit[1:] & hit[:-1]) + 1  # of overlapping equal pairs every other one counts
            for i in twice.tolist():
                if hit[i - 1]:
                    hit[i] = False
            where = np.flatnonzero(hit)
            ids[where] = (rule[where] & 0xFFFFF).astype(np.int32)
            stay = np.ones(len(ids), bool)
            stay[where + 1] = False
            ids, run = ids[stay], run[stay]
        ids, run = np.concatenate(done_ids), np.concatenate(done_run)
        order = np.argsort(run, kind="stable")
        return ids[order], run[order]

    def stream(self, text: str, block: int = BLOCK) -> Iterator[np.ndarray]:
        """Ids of one text, emitted block by block as they become stable; any text, whatever it is made of."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._stream(text, at, m.start(), block)
            yield np.array([self.merges.special[m[0]]], np.int32)
            at = m.end()
        yield from self._stream(text, at, len(text), block)

    def _stream(self, text: str, at: int, end: int, block: int) -> Iterator[np.ndarray]:
        """The same for text[at:end] without special tokens.

        State between blocks: the characters from the last sure start of a pre-token on; or, where a pre-token fills a whole
        block, its class and those of its bytes that are not stable yet.
        """
        carry, tail, like = "", None, ""
        while at < end:
            upto = min(end, at + block)
            whole, at = like + carry + text[at:upto], upto
            chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            cuts, sure = self._pretokens(chars, np.array([len(chars)])), len(chars) - HELD
            if at == end:
                sure = len(chars)
                cuts = np.append(cuts, sure)
            cuts = cuts[(cuts >= len(like)) & (cuts <= sure)]
            if tail is not None and (len(cuts) or sure > 1):  # the open pre-token goes on to the first cut
                stop = int(cuts[0]) if len(cuts) else sure
                ids, tail = self._go_on(tail + whole[1:stop].encode(), len(cuts) > 0)
                yield ids
                if not len(cuts):
                    carry = whole[stop:]
                    continue
                like = ""
            if len(cuts) > 1:
                yield self._ids(whole[: cuts[-1]], chars[: cuts[-1]], cuts[:-1], cuts[1:])[0] if not cuts[0] else self._ids(whole[cuts[0] : cuts[-1]], chars[cuts[0] : cuts[-1]], cuts[:-1] - cuts[0], cuts[1:] - cuts[0])[0]
            carry = whole[cuts[-1] :] if len(cuts) else whole[len(like) :]
            if len(cuts) == 1 and at < end and tail is None and sure > cuts[0]:  # one pre-token from here on
                ids, tail = self._go_on(whole[cuts[0] : sure].encode(), False)
                yield ids
                carry, like = whole[sure:], LIKE[self.kind[chars[sure]]]

    def _go_on(self, data: bytes, ended: bool) -> tuple[np.ndarray, bytes | None]:
        """Stable ids of a pre-token's bytes, and the rest of them."""
        ids, _, at = self._transduce(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), ended)
        return ids, None if ended else data[int(at[0]) :]


class PairTable:
    """Rules by pair of ids, looked up for whole arrays; open addressing in a table that is mostly empty."""

    BITS = 19

    def __init__(self, rule: dict[int, int]):
        keys = np.array(list(rule), np.int64)
        values = np.array(list(rule.values()), np.int64)
        self.none = np.int64(1) << np.int64(60)
        self.key = np.full(1 << self.BITS, -1, np.int64)
        self.value = np.full(1 << self.BITS, self.none)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.key[slot] < 0
            _, one = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[one] = True
            put &= free
            self.key[slot[put]], self.value[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.value[slot], self.none)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + k) & ((1 << self.BITS) - 1)
            there = self.key[at]
            same = there == keys[open_]
            out[open_[same]] = self.value[at[same]]
            open_ = open_[~same & (there >= 0)]
        return out


@lru_cache(1)
def character_classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, last)))
        for value, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[first + m.start() : first + m.end()] = value
    return out


class Decoder:
    """Ids to text, a block at a time. State: the bytes of a character that has begun but not ended."""

    def __init__(self, merges: Merges):
        self.flat, self.at, self.size = merges.flat()
        self.open = b""

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.at[ids], self.size[ids])]

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        return self.feed_bytes(self.bytes_of(np.asarray(ids, np.int64)).tobytes(), last)

    def feed_bytes(self, data: bytes, last: bool = False) -> str:
        data = self.open + data
        keep = 0 if last else self._unfinished(data)
        self.open, data = (data[len(data) - keep :], data[: len(data) - keep]) if keep else (b"", data)
        return data.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end are the start of a character that the next bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                need = 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 1
                return back if need > back else 0
        return 0


@lru_cache(2)
def merges_at(path: str) -> Merges:
    return Merges(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def blocks(texts: Iterable[str | None], chars: int) -> Iterator[list[str]]:
    """Texts in lists of about so many characters; null becomes empty."""
    out, size = [], 0
    for t in texts:
        out.append(t or "")
        size += len(out[-1])
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def digests(encoder: Encoder, texts: list[str], block: int = BLOCK, keep: bool = True) -> Iterator[tuple[int, str, str, np.ndarray | None]]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them, and with ``keep`` the ids, by text."""
    if len(texts) == 1 and len(texts[0]) > block:  # a long text goes through in blocks
        ids, back, n, decoder, kept = hashlib.sha256(), hashlib.sha256(), 0, Decoder(encoder.merges), []
        for part in encoder.stream(texts[0], block):
            ids.update(part.astype("<u4").tobytes())
            back.update(decoder.feed(part).encode())
            if keep:
                kept.append(part)
            n += len(part)
        back.update(decoder.feed(np.zeros(0, np.int64), last=True).encode())
        yield n, ids.hexdigest(), back.hexdigest(), np.concatenate(kept) if keep else None
        return
    flat, ends = encoder.ids(texts)
    raw = flat.astype("<u4")
    decoder = Decoder(encoder.merges)
    data = decoder.bytes_of(flat.astype(np.int64)).tobytes()
    size = np.concatenate((np.zeros(1, np.int64), np.cumsum(decoder.size[flat])))
    at = 0
    for end in ends.tolist():
        text = decoder.feed_bytes(data[size[at] : size[end]], last=True)
        yield end - at, hashlib.sha256(raw[at:end]).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), flat[at:end]
        at = end


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text; with ``ids`` also the ids.

    ``path`` is a tokenizer file that all workers can open. Null texts count as empty (0 tokens); ids may be
    null or repeat, each row gives a row; an empty table gives an empty result. Other columns are not read. Nothing is
    shuffled. A very long text is read in blocks; only its ids, if they are wanted, are held as a whole.
    """
    path = path or default_path()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_at(path))
        for batch in batches:
            keys, at = batch.column(0), 0
            for texts in blocks((x.as_py() for x in batch.column(1)), BLOCK):
                # a long text is alone in its block, or else last in it
                groups = [texts[:-1], texts[-1:]] if len(texts[-1]) > BLOCK else [texts]
                rows = [r for g in groups if g for r in digests(encoder, g, keep=ids)]
                cols = [keys[at : at + len(rows)], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                at += len(rows)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def decode_column(path: str | None = None):
    """A pandas UDF from array<int> to string; null gives null."""
    from pyspark.sql.functions import pandas_udf

    path = path or default_path()

    @pandas_udf("string")
    def decode(col: pd.Series) -> pd.Series:
        m = merges_at(path)
        return col.map(lambda ids: None if ids is None else Decoder(m).feed(np.asarray(ids, np.int64), last=True))

    return decode


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"))
