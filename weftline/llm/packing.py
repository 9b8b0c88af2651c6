"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenized where they are read; only piece lengths and checksums go on. Pieces are dealt by hash into blocks of about
BLOCK pieces. For each block several islands, tasks of their own, evolve packings with different seeds. A chromosome is a packing; a
population starts from best fit in random orders. Crossover injects whole well-filled bins of one parent, of any rank, into the other,
drops the bins that they duplicate and the ill-filled ones, fills the remaining bins up by exchanging some of their documents for
displaced ones, and puts the displaced documents back by best fit. Between the rounds an island's elite moves to all islands of the
block, and at the end the packing with the fewest sequences is kept. A population that reaches the lower bound (words of the block by
capacity, rounded up) stops; one that has not done so after half of its generations takes in the best-fit decreasing packing, so
no result has more sequences than that one. Blocks each waste a part of a sequence, so the worst-filled sequences of GATHER blocks at
a time are opened and packed once more in the same way, until one group is left.

Defined results: a null text is empty and is the one token that ends it; only documents over the capacity are cut; repeated rows
are packed as documents of their own; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import carried, materialize, table, text_of

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
ROUNDS = 2
#: Of the first round; the second has half as many.
GENERATIONS = 16
POPULATION = 5
#: Blocks whose worst-filled sequences are packed together once more, and how many sequences all of them give, about.
GATHER, POOL = 64, 2048
END = 0
#: Words whose ids a worker remembers, half of them those that were asked for last.
MEMORY = 600_000
#: Characters of the texts that are tokenized together, about.
TOGETHER = 6_000_000
#: Letters that are letters to every library, in lower case and composed; with ASCII they make up the texts that are looked up.
_LETTERS = "a-zß-öø-įı-ɏ"
#: Of the tokenizer's own pre-tokens, for such texts, all but runs of letters.
_MARKS = f"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\t-\\r {_LETTERS}0-9]+)"
_OTHER = re.compile(f"[^!-~{_LETTERS}]|<\\|")


class WordTokenizer:
    """Token ids, pre-token by pre-token: those seen before are looked up, the others are encoded.

    Texts are cut into pre-tokens many at a time, and only the different ones of them are seen by Python. New words are encoded many in
    one text; the vocabulary marks a word's last token, which tells them apart again. Texts with characters on whose nature libraries
    may differ, or with special tokens, are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.last = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, n in self.tok.get_vocab().items():
            self.last[n] = token.endswith("</w>")
        self.plain = self._without_rules()
        self.runs: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def _without_rules(self):
        """The tokenizer's model without its normalizer and pattern, which leave words of a-z alone; itself where that is not so."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer(self.tok.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        words = "a the tokenizer zzzz qxj " + "abcdefghijklmnopqrstuvwxyz" * 3
        same = plain.encode(words, add_special_tokens=False).ids == self.tok.encode(words, add_special_tokens=False).ids
        return plain if same else self.tok

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str], tok) -> None:
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self.runs.update(zip(part, self._encode(part), strict=True))
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                self.runs[word] = data[start:end]
                start = end

    def _of(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens; none for the odd ones, that only their whole text tells."""
        if len(self.runs) + len(self.odd) > MEMORY // 2:
            for w in self.odd:
                self.runs.pop(w, None)
            self.runs, self.before, self.odd = {}, self.runs, set()
        self.runs[""] = b""
        new = set(words).difference(self.runs)
        again = new.intersection(self.before)
        self.runs.update(zip(again, map(self.before.__getitem__, again), strict=True))
        new -= again
        odd = {r for r in new if _OTHER.search(r)}
        self.odd |= odd
        self.runs.update(dict.fromkeys(odd, b""))
        new -= odd
        words_ = [r for r in new if r[0].isalpha()]
        self._learn_words([r for r in words_ if r.isascii()], self.plain)
        self._learn_words([r for r in words_ if not r.isascii()], self.tok)
        rest = [r for r in new if not r[0].isalpha()]
        self.runs.update(zip(rest, self._encode(rest), strict=True))
        return list(map(self.runs.__getitem__, words))

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        pool = pa.system_memory_pool()  # gives back what it does not need
        low = pa.array([t.lower() for t in texts], pa.string(), memory_pool=pool)
        low = pc.replace_substring_regex(low, pattern=_MARKS, replacement=r" \1 ", memory_pool=pool)
        cut = pc.ascii_split_whitespace(low, memory_pool=pool)
        coded = pc.dictionary_encode(cut.values, memory_pool=pool)
        words = coded.dictionary.to_pylist()
        known = self._of(words)
        place, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()
        sizes = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        every = np.frombuffer(b"".join(known), dtype="<u4")
        size = sizes[place]
        upto = np.zeros(len(size) + 1, dtype=np.int32)  # tokens are no more than bytes of TOGETHER and one text
        np.cumsum(size, out=upto[1:])
        at = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[place] - upto[:-1], size)
        at += np.arange(upto[-1], dtype=np.int32)
        ids = every[at]
        strange = np.fromiter((w in self.odd for w in words), dtype=bool, count=len(words))
        strange = set((np.searchsorted(ends, np.flatnonzero(strange[place]), side="right") - 1).tolist()) if strange.any() else set()
        at = upto[ends].tolist()
        for n, text in enumerate(texts):
            yield self._encode([text])[0] if n in strange else ids[at[n] : at[n + 1]].tobytes()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        start = held = 0
        for n, text in enumerate(texts):
            if n > start and held + len(text) > TOGETHER:
                yield from self._together(texts[start:n])
                start, held = n, 0
            held += len(text)
        yield from self._together(texts[start:])


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_for(path: str) -> WordTokenizer:
    """This Python worker's tokenizer, with what it remembers from the tasks before."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def piece_rows(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a row number of its own for each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, step, end = tokenizer_for(tokenizer_path), 4 * capacity, np.uint32(END).tobytes()
        for b in batches:
            docs_, piece, start, length, crc = [], [], [], [], []
            for doc, ids in zip(b["doc_id"], tok.ids(b["text"].tolist()), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    docs_.append(doc)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"doc_id": docs_, "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    src = docs.select(carried(F.col(id_col).cast("long")).alias("doc_id"), text_of(text_col).alias("text"))
    out = src.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("uid", F.monotonically_increasing_id())


class Bins:
    """Bins under construction; the tightest bin with room is found in the bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.room, self.free = capacity, [], [[] for _ in range(capacity + 1)], 0

    def add_bin(self, items: list[int], used: int) -> None:
        left = self.capacity - used
        self.bins.append((items, used))
        self.room[left].append(len(self.bins) - 1)
        self.free |= 1 << left

    def put(self, item: int, length: int) -> None:
        fits = self.free >> length
        if not fits:
            self.add_bin([item], length)
            return
        left = length + ((fits & -fits).bit_length() - 1)
        i = self.room[left].pop()
        if not self.room[left]:
            self.free &= ~(1 << left)
        items, used = self.bins[i]
        items.append(item)
        self.bins[i] = (items, used + length)
        left -= length
        self.room[left].append(i)
        self.free |= 1 << left


Packing = list[tuple[list[int], int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, given: Packing = ()) -> Packing:
    out = Bins(capacity)
    for items, used in given:
        out.add_bin(list(items), used)
    for i in order:
        out.put(i, lengths[i])
    return out.bins


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are full or empty rather than all alike; less is better."""
    return len(packing), -sum(used * used for _, used in packing) / capacity**2


def _fill_up(kept: Packing, displaced: list[int], lengths: list[int], capacity: int) -> tuple[Packing, list[int]]:
    """Exchange one document of a bin for a longer displaced one, or a displaced pair, that fits better; at most once a bin."""
    by: dict[int, list[int]] = {}
    for i in displaced:
        by.setdefault(lengths[i], []).append(i)
    sizes = sorted(by)
    out = []
    for items, used in kept:
        room, best = capacity - used, None
        if room and len(items) <= 16:
            for at, i in enumerate(items):
                most = lengths[i] + room
                n = bisect_right(sizes, most) - 1
                while n >= 0 and not by[sizes[n]]:
                    n -= 1
                if n >= 0 and sizes[n] > lengths[i] and (best is None or sizes[n] - lengths[i] > best[0]):
                    best = (sizes[n] - lengths[i], at, (sizes[n],))
                for m in range(n, max(-1, n - 4), -1):
                    k = bisect_right(sizes, most - sizes[m]) - 1
                    if k >= 0 and len(by[sizes[m]]) > (k == m) and by[sizes[k]] and sizes[m] + sizes[k] - lengths[i] > (best[0] if best else 0):
                        best = (sizes[m] + sizes[k] - lengths[i], at, (sizes[m], sizes[k]))
        if best:
            gain, at, new = best
            out_, items = items[at], items[:at] + items[at + 1 :] + [by[x].pop() for x in new]
            by.setdefault(lengths[out_], []).append(out_)
            if (n := bisect_right(sizes, lengths[out_])) == 0 or sizes[n - 1] != lengths[out_]:
                sizes.insert(n, lengths[out_])
            used += gain
        out.append((items, used))
    return out, [i for x in by.values() for i in x]


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject well-filled bins of ``a`` into ``b``; bins of ``b`` that hold one of their documents go, and so do its ill-filled ones;
    what they held besides comes back by exchanges and by best fit, longest first."""
    fill = sorted((used for _, used in a), reverse=True)
    exact = capacity - rng.choice((0, 0, 1, capacity // 512))
    least = exact if fill[len(fill) // 8] >= exact else fill[int((len(fill) - 1) * rng.uniform(0.3, 0.9))]
    pool = [x for x in a if x[1] >= least]
    many = sorted(len(x[0]) for x in pool)[int((len(pool) - 1) * rng.choice((0.5, 0.75, 1.0)))]  # bins of few documents leave small ones to fill gaps
    pool = [x for x in pool if len(x[0]) <= many]
    injected = rng.sample(pool, max(1, int(len(pool) * rng.uniform(0.5, 1.0))))
    inside = {i for items, _ in injected for i in items}
    well = exact if least == exact else sorted(used for _, used in b)[int((len(b) - 1) * rng.uniform(0.05, 0.5))] + 1
    kept, displaced = list(injected), []
    for items, used in b:
        if used >= well and len(items) <= many and inside.isdisjoint(items):
            kept.append((items, used))
        else:
            displaced += [i for i in items if i not in inside]
    kept, displaced = _fill_up(kept, displaced, lengths, capacity)
    spread = rng.choice((0.0, 0.002, 0.02)) * capacity
    displaced.sort(key=lambda i: -lengths[i] + rng.random() * spread)
    return best_fit(displaced, lengths, capacity, kept)


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[Packing], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[Packing, int]:
    """The best packing found, and after how many crossovers; ``elites`` are packings that came from other islands and rounds."""
    rng = random.Random(seed)
    bound = -(-sum(lengths) // capacity)
    everyone = list(range(len(lengths)))
    scored = lambda p: (fitness(p, capacity), p)
    people = [scored(p) for p in elites]
    while len(people) < population and (not people or min(people, key=_score)[0][0] > bound):
        people.append(scored(best_fit(rng.sample(everyone, len(everyone)), lengths, capacity)))
    people.sort(key=_score)
    done = 0
    while done < generations and people[0][0][0] > bound:
        if done == generations // 2:
            people[-1] = scored(best_fit(sorted(everyone, key=lambda i: -lengths[i]), lengths, capacity))
            people.sort(key=_score)
        i, j = (min(rng.sample(range(len(people)), 2)) for _ in range(2))  # of two, the fitter one is a parent
        if i == j:
            i = (j + 1 + rng.randrange(len(people) - 1)) % len(people)
        child = scored(crossover(people[i][1], people[j][1], lengths, capacity, rng))
        if all(child[0] != p[0] for p in people):  # one of each kind
            people = sorted([*people[: population - 1], child], key=_score)
        done += 1
    best = people[0][1]
    return (_settled(best, lengths, capacity, rng) if done or not elites else best), done


def _score(person: tuple) -> tuple:
    return person[0]


def _settled(packing: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """The room that a packing leaves, gathered in few bins: documents of bins that are not full, and of some that are, go back
    longest first, as long as that leaves no more bins and emptier ones."""
    for share in (1.0, 0.7):
        full = [x for x in packing if x[1] == capacity and rng.random() < share]
        inside = {i for items, _ in full for i in items}
        open_ = [i for items, _ in packing for i in items if i not in inside]
        kept, open_ = _fill_up(full, open_, lengths, capacity)
        child = best_fit(sorted(open_, key=lambda i: -lengths[i]), lengths, capacity, kept)
        packing = min(packing, child, key=lambda p: fitness(p, capacity))
    return packing


def _bins_of(column: list[int]) -> Packing:
    found: dict[int, list[int]] = {}
    for i, b in enumerate(column):
        found.setdefault(b, []).append(i)
    return list(found.values())


def _island(capacity: int, round_: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = key
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].tolist()
        elites = []
        if round_:
            elites = [[(items, sum(lengths[i] for i in items)) for items in _bins_of(list(column))] for column in zip(*pdf["elites"], strict=True)]
        best, done = evolve(lengths, capacity, (int(block) * 1_000_003 + int(island) * 1009 + round_) & 0xFFFFFFFF, elites, GENERATIONS // (round_ + 1))
        place = np.empty(len(lengths), dtype=np.int32)
        for n, (items, _) in enumerate(best):
            place[items] = n
        crossovers = done + (int(pdf["crossovers"].iloc[0]) if round_ else 0)
        return pd.DataFrame({"block": block, "island": island, "uid": pdf["uid"], "length": pdf["length"], "bin": place, "n_bins": len(best), "crossovers": crossovers})

    return run


_STATE = "block long, island int, uid long, length int, bin int, n_bins int, crossovers int"


def evolved(light: DataFrame, capacity: int, islands: int, rounds: int) -> DataFrame:
    """The best packing of each block of ``light`` (uid, length, block), a row a piece, materialized."""
    everywhere = F.explode(F.array(*[F.lit(i) for i in range(islands)]))
    state = light.withColumn("island", everywhere)
    for r in range(rounds):
        state = materialize(state.groupBy("block", "island").applyInPandas(_island(capacity, r), _STATE), f"pack-round{r}")
        if r + 1 < rounds:
            elites = state.groupBy("block", "uid").agg(F.first("length").alias("length"), F.max("crossovers").alias("crossovers"), F.transform(F.sort_array(F.collect_list(F.struct("island", "bin"))), lambda x: x["bin"]).alias("elites"))
            state = elites.withColumn("island", everywhere)
    # one row a block and island, as many as blocks: found by an aggregate, joined as a shuffle unless small
    best = state.groupBy("block").agg(F.min_by("island", F.struct("n_bins", "island")).alias("island"))
    return state.join(best, ["block", "island"])


def _placed(worst: int):
    """Pieces of a block with sequence and offset; ``open`` are those of its ``worst`` least filled sequences."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "uid"], ignore_index=True)
        length = pdf["length"].astype("int64")
        total, used = length.groupby(pdf["bin"]).cumsum(), length.groupby(pdf["bin"]).sum()
        open_ = pdf["bin"].isin(used.sort_values(kind="stable").index[:worst])
        return pd.DataFrame({"uid": pdf["uid"], "length": pdf["length"], "block": pdf["block"], "sequence_id": pdf["block"].astype("int64") * (1 << 24) + pdf["bin"], "offset": total - length, "open": open_})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, *, block: int = BLOCK, islands: int = ISLANDS, rounds: int = ROUNDS, gather: int = GATHER, pool: int = POOL) -> DataFrame:
    """``pieces`` (a materialized table with uid and length) plus sequence_id and offset."""
    groups, base, placed = max(1, round(pieces.count() / block)), 0, None
    light = pieces.select("uid", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("uid", F.lit("block")), F.lit(groups)).alias("block"))
    while True:
        done = groups == 1
        schema = "uid long, length int, block long, sequence_id long, offset long, open boolean"
        now = evolved(light, capacity, islands, rounds).groupBy("block").applyInPandas(_placed(0 if done else max(1, pool // min(gather, groups))), schema)
        if done:
            rest = now.select("uid", "sequence_id", "offset")
            return pieces.join(rest if placed is None else placed.unionByName(rest), "uid").drop("uid")
        now = materialize(now, "pack-placed")
        closed = now.where(~F.col("open")).select("uid", "sequence_id", "offset")
        placed = closed if placed is None else placed.unionByName(closed)
        before, base, groups = base, base + groups, -(-groups // gather)
        light = now.where("open").select("uid", "length", (F.floor((F.col("block") - before) / gather) + base).alias("block"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(materialize(piece_rows(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces"), capacity, **how)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each document's tokens are in the packed sequences."""
    return pack_documents(docs, default_tokenizer())
