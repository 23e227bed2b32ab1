"""BPE encoding and decoding with a lexicon of frequent words.

The words of the whole corpus are counted; the most frequent ones are merged once
and compiled into a minimal acyclic transducer: words that share endings share
states, and numbers along the arcs add up to the word's entry in a table of ids.
Its file goes to every executor, where tasks map it into memory and walk it for all
new words of a batch at once.  All other new words are merged exactly, by rank, and
also together: each round makes the next merge of every word.

A text is cut at ASCII white space: no token, normalisation or special token of the
vocabulary crosses it, so equal pieces have equal ids and are merged once per task.

Defined cases: null text is empty and has no ids; repeated rows each get a result;
the strings of special tokens give their ids, as in the tokenizers library; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import STEP_BYTES, documents, stored, text_steps

#: Words in the lexicon, and the bytes of the longest; every other word is merged exactly.
LEXICON_WORDS, LEXICON_WORD_BYTES = 32_768, 48
#: Entries of a task's table of words and ids; it starts anew when full.
CACHE_WORDS = 300_000
#: Below it every letter is composed, has one lower-case letter and its class in any version of Unicode.
LATIN = 0x130
#: Words of at most so many bytes are merged together, in groups by length; longer ones one by one.
GROUPS = ((2, 4), (5, 8), (9, 12), (13, 32))
#: A place among the bytes of such a word takes so many bits.
PLACE_BITS = 5
#: No merge, and no token.
NONE, NO_TOKEN = 0xFFFFFFFF, 0xFFFFF


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Pairs:
    """Ranks of pairs of tokens in a table with open addressing, looked up for many pairs at once; shifted, so that a place fits below."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, self.EMPTY), np.full(1 << bits, NONE, np.uint32)
        at = self.slot(keys)
        while len(keys):
            # of the keys that want one free slot the last one has it, all others go on
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.ranks[at[mine]] = ranks[mine].astype(np.uint32) << np.uint32(PLACE_BITS)
            keys, ranks, at = keys[~mine], ranks[~mine], (at[~mine] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The shifted rank of each pair, or NONE."""
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        at = self.slot(key)
        have = self.keys[at]
        hit = have == key
        out = np.where(hit, self.ranks[at], np.uint32(NONE))
        rest = np.flatnonzero(~hit & (have != self.EMPTY))
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            have, want = self.keys[at], key[rest]
            hit = have == want
            out[rest[hit]] = self.ranks[at[hit]]
            on = ~hit & (have != self.EMPTY)
            rest, at = rest[on], at[on]
        return out


class Merger:
    """Exact encoding of pieces without white space."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        whole = json.loads(spec)
        model = whole["model"]
        self.vocab = vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # the new token below the rank, so that the least value is the lowest rank; ids have at most 20 bits
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.made = np.zeros(len(model["merges"]) + 1, np.int64)
        values = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.made[values >> 20] = values & 0xFFFFF
        self.pairs = Pairs(np.fromiter(self.ranks, np.uint64, len(self.ranks)), values >> 20)
        letters = byte_letters()
        self.bytes = {letter: b for b, letter in letters.items()}
        self.inner = [vocab.get(letters[b], -1) for b in range(256)]
        self.final = [vocab.get(letters[b] + suffix, -1) for b in range(256)]
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the library's normaliser and splitter, without the vocabulary
        bare = Tokenizer.from_str(json.dumps(whole | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normal, self.split = bare.normalizer.normalize_str, bare.pre_tokenizer.pre_tokenize_str
        self.latin = regex.compile(whole["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # of each character below LATIN, and of all others as one: whether its pieces are cut one by one, its class, and
        # its bytes' tokens within a word and at its end
        self.odd, self.kind = np.ones(LATIN + 1, bool), np.full(LATIN + 1, 3, np.uint8)
        self.symbols = np.full((2, LATIN + 1, 2), -1, np.int64)
        starts = {x[0] for x in self.special if x} | {"'"}
        for c in map(chr, range(LATIN)):
            if c.isprintable() and c not in starts:
                *head, tail = c.lower().encode()
                self.odd[ord(c)] = False
                self.kind[ord(c)] = {"L": 0, "N": 1}.get(unicodedata.category(c)[0], 2)
                for k, ids in enumerate((self.inner, self.final)):
                    self.symbols[k, ord(c), : len(head) + 1] = [*map(self.inner.__getitem__, head), ids[tail]]
        self.odd[ord("\n")] = False  # ends each piece

    def tokens(self) -> list[bytes]:
        out = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in {**self.vocab, **self.special}.items():
            out[i] = token.encode()
        return out

    def words(self, part: str) -> list[bytes]:
        """The words whose bytes are merged, each by itself."""
        if part.isprintable() and max(part) < chr(LATIN):
            return [x.encode() for x in self.latin(part.lower())]
        return [bytes(map(self.bytes.__getitem__, x)) for x, _ in self.split(self.normal(part))]

    def encode(self, piece: str) -> list[int]:
        return [i for _, ids, _ in self.encoded([piece.encode()]) for i in ids.tolist()]

    def encoded(self, pieces: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """All pieces in parts, in any order: those of a part, their ids, and how many ids there are up to the end of each."""
        places = np.cumsum([0, *map(len, pieces)])
        lo = 0
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(places, places[lo] + STEP_BYTES, "right")) - 1)
            yield from self.together(pieces[lo:hi])
            lo = hi

    def together(self, pieces: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
        points = np.frombuffer(b"\n".join([*pieces, b""]).decode().encode("utf-32-le"), "<u4")
        ends = np.flatnonzero(points == 10)
        points = np.minimum(points, LATIN).astype(np.int64)
        odd = np.diff(np.cumsum(self.odd[points])[ends], prepend=0) > 0
        if odd.any():
            points = points[np.repeat(~odd, np.diff(ends, prepend=-1))]
            ends = np.flatnonzero(points == 10)
            yield self.one_by_one([pieces[i] for i in np.flatnonzero(odd).tolist()])
            pieces = [pieces[i] for i in np.flatnonzero(~odd).tolist()]
        if pieces:
            # below LATIN a word ends where the class changes and after each digit
            kind = self.kind[points]
            last = np.ones(len(points), bool)
            last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 1)
            symbols = self.symbols[last.astype(np.int64), points].ravel()
            there = symbols >= 0
            upto = np.cumsum(there)[1::2]
            yield pieces, *self.merge(symbols[there], upto[last], upto[ends])

    def one_by_one(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The same for pieces with special tokens, apostrophes or other characters, which are cut one by one."""
        symbols: list[int] = []
        words, ends = [], []
        for piece in map(bytes.decode, pieces):
            for part in self.cut.split(piece) if self.cut else (piece,):
                if part in self.special:
                    symbols.append(self.special[part])
                    words.append(len(symbols))
                elif part:
                    for word in self.words(part):
                        symbols += [*map(self.inner.__getitem__, word[:-1]), self.final[word[-1]]]
                        words.append(len(symbols))
            ends.append(len(symbols))
        found = np.array(symbols, np.int64)
        upto = np.cumsum(np.append(0, found >= 0))
        return pieces, *self.merge(found[found >= 0], upto[words], upto[ends])

    def merge(self, symbols: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words, which end at the symbols numbered words; the ids, and those up to each of ends.

        In each word lowest rank first, leftmost first among equals; a round makes one merge of every word.
        """
        n = len(symbols)
        length = np.diff(words, prepend=0)
        start = words - length
        # place n stands beside the first and the last symbol of a word
        token = np.append(symbols, NO_TOKEN)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[words[length > 0] - 1] = n
        before[start[length > 0]] = n
        there = np.ones(n, bool)
        first = self.pairs.get(token[:-1], token[1:])
        for least, most in GROUPS:
            those = np.flatnonzero((length >= least) & (length <= most))
            if not len(those):
                continue
            begin, size = start[those], length[those]
            # a row for each place, with its pair's rank and the place; the last row is of no pair
            ranks = np.full((most, len(those)), NONE, np.uint32)
            for k in range(most - 1):
                have = np.flatnonzero(size > k + 1)
                ranks[k, have] = first[begin[have] + k] | np.uint32(k)
            while len(begin):
                best = ranks[:-1].min(axis=0)
                column = np.flatnonzero(best != NONE)
                if len(column) * 2 < len(begin):
                    ranks, begin, best = ranks[:, column], begin[column], best[column]
                    column = np.arange(len(column))
                best, zero = best[column], begin[column]
                place = (best & np.uint32((1 << PLACE_BITS) - 1)).astype(np.int64)
                left = zero + place
                new = self.made[best >> np.uint32(PLACE_BITS)]
                right = after[left]
                follow, ahead = after[right], before[left]
                token[left], there[right] = new, False
                after[left], before[follow] = follow, left
                found = self.pairs.get(np.concatenate([new, token[ahead]]), np.concatenate([token[follow], new]))
                ranks[right - zero, column] = NONE
                ranks[place, column] = found[: len(new)] | place.astype(np.uint32)
                ahead = np.where(ahead == n, most - 1, ahead - zero)
                ranks[ahead, column] = found[len(new) :] | ahead.astype(np.uint32)
        for i in np.flatnonzero(length > GROUPS[-1][1]).tolist():
            lo, hi = int(start[i]), int(words[i])
            ids = self.merge_long(token[lo:hi].tolist())
            token[lo : lo + len(ids)] = ids
            there[lo + len(ids) : hi] = False
        return token[:-1][there], np.append(0, np.cumsum(there))[ends]

    def merge_long(self, ids: list[int]) -> list[int]:
        """One word with a heap, near linear in the length."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            new = rank & 0xFFFFF
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]


class Lexicon:
    """Arcs of the minimal acyclic transducer in arrays: key (state * 256 + byte), target, number to add."""

    NAMES = ("keys", "targets", "adds", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: list[tuple[bytes, list[int]]]) -> Lexicon:
        """entries: words in byte order, each once, with their ids."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]
        last = b""

        def freeze(depth: int) -> None:
            """Replaces the states of the last word below depth by equal ones that are known."""
            while len(path) > depth + 1:
                state = path.pop()
                form = (final[state], tuple(arcs[state].items()))
                same = known.setdefault(form, state)
                if same != state:
                    arcs[path[-1]][last[len(path) - 1]] = same

        for word, _ in entries:
            common = len(os.path.commonprefix([word, last]))
            freeze(common)
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
            last = word
        freeze(0)
        live, number = {0: 0}, [0]
        for state in number:  # grows meanwhile
            for target in arcs[state].values():
                if target not in live:
                    live[target] = len(live)
                    number.append(target)
        words: dict[int, int] = {}
        for state in _postorder(arcs):
            words[state] = final[state] + sum(words[t] for t in arcs[state].values())
        keys, targets, adds = [], [], []
        for state in number:
            add = int(final[state])
            for byte, target in sorted(arcs[state].items()):
                keys.append(live[state] << 8 | byte)
                targets.append(live[target])
                adds.append(add)
                add += words[target]
        starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
        put = lambda x: np.array(x, np.uint32)
        return cls({"keys": put(keys), "targets": put(targets), "adds": put(adds), "final": put([final[s] for s in number]), "starts": put(starts), "ids": put([i for _, ids in entries for i in ids])})

    def save(self, path: str) -> None:
        parts = [getattr(self, k) for k in self.NAMES]
        np.save(path, np.concatenate([np.array([len(x) for x in parts], np.uint32), *parts]))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        all_, at, arrays = np.asarray(np.load(path, mmap_mode="r")), len(cls.NAMES), {}
        for k, n in zip(cls.NAMES, all_[: len(cls.NAMES)].tolist(), strict=True):
            arrays[k], at = all_[at : at + n], at + n
        return cls(arrays)

    def encoded(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some entries, and how many there are up to the end of each."""
        begin = self.starts[entries].astype(np.int64)
        size = self.starts[entries + 1] - begin
        ends = np.cumsum(size)
        return self.ids[np.repeat(begin + size - ends, size) + np.arange(size.sum())], ends

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Each word's entry, or -1; all words take their steps together."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1)
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length) - length
        state, entry = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        alive = np.flatnonzero(length > 0)
        found = np.zeros(n, bool)
        for step in range(int(length.max(initial=0))):
            key = state[alive] << np.uint32(8) | data[start[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            entry[alive] += self.adds[at]
            over = length[alive] == step + 1
            found[alive[over]] = self.final[state[alive[over]]] == 1
            alive = alive[~over]
            if not len(alive):
                break
        return np.where(found, entry, -1)


def _postorder(arcs: list[dict[int, int]]) -> list[int]:
    out, seen, stack = [], {0}, [(0, iter(arcs[0].values()))]
    while stack:
        state, rest = stack[-1]
        for target in rest:
            if target not in seen:
                seen.add(target)
                stack.append((target, iter(arcs[target].values())))
                break
        else:
            out.append(state)
            stack.pop()
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each piece between white space occurs in all texts."""

    def count(batches):
        from collections import Counter

        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, data, _ in text_joined(batch.column(0)):
                counts.update(data.split())
                if len(counts) > CACHE_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def text_joined(column: pa.Array):
    """Steps of a text column as one byte string with a line end after each text."""
    for lo, hi, data, offsets in text_steps(column):
        raw = data.tobytes()
        yield lo, hi, b"\n".join(raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), offsets


def build_lexicon(docs: DataFrame, merger: Merger, words: int = LEXICON_WORDS) -> Lexicon:
    """The most frequent words of all texts, by a least count that at most `words` of them reach; only those come to the driver."""
    counts = stored(word_counts(docs).where((F.col("n") > 1) & (F.length("word") <= LEXICON_WORD_BYTES)), "words")
    # counts in steps of an eighth of a power of two: a few hundred rows at any size
    step = F.floor(F.log2("n") * 8)
    least, have = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        have += r["words"]
        if have > words:
            break
        least = r["least"]
    frequent = counts.where(F.col("n") >= least).select("word").collect() if least else []
    entries = []
    for found, ids, ends in merger.encoded([bytes(r["word"]) for r in frequent]):
        entries += zip(found, np.split(ids, ends[:-1]), strict=True)
    return Lexicon.compile([(w, ids.tolist()) for w, ids in sorted(entries, key=lambda x: x[0])])


def encode(docs: DataFrame, vocabulary: str | None = None, digests: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """All columns of docs with the ids of each text, which replace a column of that name; with digests, what op4 returns instead."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text") if digests else docs.select(*[c for c in docs.columns if c.lower() != "ids"])
    at = docs.columns.index("text")
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = os.path.join(tempfile.mkdtemp(), name)
    build_lexicon(docs, Merger(spec), lexicon_words).save(path)
    spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(spec)  # as large as the vocabulary's file
    field = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {field}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if not digests:
        schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        merger, lexicon = Merger(shared.value), Lexicon.mapped(SparkFiles.get(name))
        cache, spoken = {}, {}
        tokens = [b" " + x for x in merger.tokens()]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))

        def learn(words, ids, ends):
            places = [0, *(ends * 4).tolist()]
            raw = ids.astype("<u4").tobytes()
            cache.update(zip(words, [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], strict=True))
            if digests:
                # decoded token by token, once for equal pieces
                raw = b"".join(map(tokens.__getitem__, ids.tolist()))
                places = [0, *np.append(0, np.cumsum(sizes[ids]))[ends].tolist()]
                spoken.update(zip(words, [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], strict=True))

        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(at)):
                raw = data.tobytes()
                pieces = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                    spoken.clear()
                new = [x for x in set().union(*pieces) if x not in cache]
                entries = lexicon.lookup(new)
                known = entries >= 0
                learn([new[i] for i in np.flatnonzero(known).tolist()], *lexicon.encoded(entries[known]))
                for part in merger.encoded([new[i] for i in np.flatnonzero(~known).tolist()]):
                    learn(*part)
                coded = [b"".join(map(cache.__getitem__, x)) for x in pieces]
                if digests:
                    key = batch.column(0).slice(lo, hi - lo)
                    decoded = [b"".join(map(spoken.__getitem__, x))[1:] for x in pieces]
                    sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values])
                    out = [key, pa.array([len(x) // 4 for x in coded], pa.int64()), sha(coded), sha(decoded)]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, ids], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    """The vocabulary has no decoder, so its tokens are joined by spaces."""
    return b" ".join([tokens[i] for i in ids])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir, "doc_id", "text"), digests=True)
