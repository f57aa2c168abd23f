"""Language-model scores of whole texts: word counts over a subword lattice.

The probability of a word that was never seen comes from all its segmentations into the pieces of an existing
vocabulary: in log space a forward recursion over the characters adds up the segmentations, each the product of
its pieces' probabilities. A piece that begins a word carries the word mark, so the probabilities of all words
sum to one. The vocabulary's own scores start the piece probabilities (merge ranks enter as rank ** -1, since
the file holds ranks) and stay in them as a prior; expected piece counts over all distinct words of the
learning texts are added in `rounds` passes. The vocabulary itself is not changed.

Counts of words are smoothed with that lattice (a discount d and a strength t, chosen by the leave-one-out
likelihood of the counts): P(w) = (max(c - d, 0) + (t + d V) G(w)) / (N + t), G the lattice probability.

A text belongs to a class that is not known, such as its language: with the counts c_k of the learning texts of
class k, P_k(w) = OWN c_k / N_k + (1 - OWN) P(w). Every class has counts of its own, and the texts without a label
are one more class. Words of a text repeat: after n words, m of them w, the next is w
with probability (m + BURST P_k(w)) / (BURST + n). The probability of the text is the sum over the classes, by
their shares of the learning texts. All of this is a probability over every possible text.

Counts cover all learning texts. The `head` most frequent words at most go to every task (their number is
bounded by the parameter); all other words of a text are joined with the count table.

Defined cases: a null or empty text is the single end token; repeated rows are scored each; ids may be null;
without learning texts the lattice alone scores; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.batches import Words, flat, fold, map_texts
from ostinato.llm.storage import written

MARK = 0x2581                 # the word mark of the vocabulary
FOREIGN = 0xFFFFFF            # stands for a mark inside a word
BYTE_MASS = 1e-4              # probability of all byte pieces, for characters without a piece
END_SHARE = 0.01              # of G for the end of a text
HEAD = 300_000
ROUNDS = 2
PRIOR = 2_000.0               # expected counts that the vocabulary's own scores are worth
OWN = 0.8                     # weight of the class's own counts
BURST = 1600.0                # words that the model is worth against those of the text itself
CLASSES = 8                   # classes from which batches and the head shrink, so that memory stays
DISCOUNTS = (0.0, 0.2, 0.4, 0.6, 0.8)
STRENGTHS = (1.0, 100.0, 10_000.0)
BATCH_BYTES = 12 << 20
CHUNK_WORDS = 25_000


class Pieces:
    """Pieces of a sentencepiece file, with all their prefixes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = chr(MARK)
        found = []
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.get_score(k) < -1e8:
                continue
            piece = model.id_to_piece(k)
            if mark not in piece[1:]:
                found.append((piece, model.get_score(k)))
        self.names = [p for p, _ in found]
        score = np.array([s for _, s in found])
        ranks = (score == np.round(score)).all()
        start = 1 / (3.0 - score) if ranks else np.exp(score)
        self.start = start / start.sum() * (1 - BYTE_MASS)
        self.longest = max(map(len, self.names))
        prefixes: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        for k, piece in enumerate(self.names):
            h = 0
            for n, c in enumerate(piece, 1):
                h = step(h, ord(c))
                prefixes[n].setdefault(h, -1)
            prefixes[len(piece)][h] = k
        self.keys, self.ids = [None], [None]
        for table in prefixes[1:]:
            key = np.array(list(table), np.uint64)
            order = np.argsort(key)
            self.keys.append(key[order])
            self.ids.append(np.array(list(table.values()), np.int64)[order])


FACTOR = 0x9E3779B97F4A7C15


def step(h: int, code: int) -> int:
    """Hash of a string with one more character."""
    h = (h * FACTOR + code + 1) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


def steps(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = h * np.uint64(FACTOR) + code + np.uint64(1)
    return h ^ (h >> np.uint64(29))


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All segmentations of some words, as edges between the nodes before, between and after their characters."""

    def __init__(self, words: list[str], table: Pieces):
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        self.order = np.array(order, np.int64)
        text = "".join(words[k] for k in order)
        length = np.array([len(words[k]) for k in order], np.int64)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.where(code == MARK, np.uint64(FOREIGN), code)
        n = length + 1                                             # characters with the mark
        ends = np.cumsum(n)
        self.first = ends - n + np.arange(len(n))                  # node before the mark
        self.length = n
        codes = np.full(int(ends[-1]) if len(n) else 0, MARK, np.uint64)
        inside = np.ones(len(codes), bool)
        inside[ends - n] = False
        codes[inside] = code
        stop = np.repeat(ends, n)
        node = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        start, size, piece = [], [], []
        lone = np.ones(len(codes), bool)
        for width in range(1, table.longest + 1):
            ok = at + width <= stop[at]
            at, h = at[ok], h[ok]
            h = steps(h, codes[at + width - 1])
            keys = table.keys[width]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[place] == h
            at, h, place = at[ok], h[ok], place[ok]
            own = table.ids[width][place]
            real = own >= 0
            start.append(node[at[real]])
            size.append(np.full(int(real.sum()), width))
            piece.append(own[real])
            if width == 1:
                lone[at[real]] = False
            if not len(at):
                break
        # characters without a piece: their bytes
        plain = np.flatnonzero(lone)
        cost = 1 + (codes[plain] >= 0x80) + (codes[plain] >= 0x800).astype(int) + (codes[plain] >= 0x10000)
        self.start = np.concatenate([*start, node[plain]])
        self.size = np.concatenate([*size, np.ones(len(plain), np.int64)])
        self.piece = np.concatenate([*piece, np.full(len(plain), -1)])
        self.byte_cost = np.concatenate([np.zeros(len(self.start) - len(plain)), cost * math.log(BYTE_MASS / 256)])
        self.longest = table.longest
        self.nodes = len(codes) + len(n)

    def _weights(self, logp: np.ndarray) -> np.ndarray:
        return np.where(self.piece < 0, self.byte_cost, logp[self.piece])

    def _sweep(self, into: np.ndarray, forward: bool) -> np.ndarray:
        """Log sums over paths from the first node (or to the last) of every word, to (from) every node."""
        sums = np.full(self.nodes, -np.inf)
        sums[self.first if forward else self.first + self.length] = 0.0
        top = int(self.length[0]) if len(self.length) else 0
        active = np.searchsorted(-self.length, -np.arange(top + 1), "right")    # words of at least k characters
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(1, top + 1):
                m, back = active[k], np.arange(1, min(k, self.longest) + 1)
                node = self.first[:m] + (k if forward else self.length[:m] - k)
                other = node[:, None] - back if forward else node[:, None] + back
                ways = sums[other] + into[node[:, None] if forward else other, back - 1]
                best = ways.max(axis=1)
                sums[node] = np.where(np.isinf(best), -np.inf, best + np.log(np.exp(ways - best[:, None]).sum(axis=1)))
        return sums

    def _table(self, weights: np.ndarray) -> np.ndarray:
        into = np.full((self.nodes, self.longest), -np.inf)
        into[self.start + self.size, self.size - 1] = weights
        return into

    def marginal(self, logp: np.ndarray) -> np.ndarray:
        """Log probability of each word over all segmentations."""
        sums = self._sweep(self._table(self._weights(logp)), True)
        out = np.empty(len(self.length))
        out[self.order] = sums[self.first + self.length]
        return out

    def expected(self, logp: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected number of uses of each piece, each word counted once."""
        weights = self._weights(logp)
        into = self._table(weights)
        ahead, after = self._sweep(into, True), self._sweep(into, False)
        of_word = np.repeat(np.arange(len(self.length)), self.length + 1)
        total = ahead[self.first + self.length][of_word[self.start]]
        share = np.exp(ahead[self.start] + weights + after[self.start + self.size] - total)
        real = self.piece >= 0
        return np.bincount(self.piece[real], weights=share[real], minlength=n_pieces)


def chunks(words: list[str]):
    for at in range(0, len(words), CHUNK_WORDS):
        yield words[at:at + CHUNK_WORDS]


def word_counts(docs: DataFrame, classes: int) -> DataFrame:
    """(word, c, c0, c1, ...): every word of docs(text, learn, class) with its number in the learning texts, and in those of each class."""
    names = ["c", *(f"c{k}" for k in range(classes))]

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = flat(batch.column("text"))
        words = Words(fold(data), offsets)
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)[words.row_of()]
        own = batch.column("class").fill_null(-1).to_numpy(zero_copy_only=False)[words.row_of()]
        size = len(words.vocabulary)
        used = np.zeros(size, bool)
        used[words.codes] = True
        out = {"word": words.vocabulary.filter(pa.array(used)).cast(pa.string()), "c": pa.array(np.bincount(words.codes[learn], minlength=size)[used], pa.int64())}
        return out | {f"c{k}": pa.array(np.bincount(words.codes[learn & (own == k)], minlength=size)[used], pa.int64()) for k in range(classes)}

    limit = BATCH_BYTES * CLASSES // max(CLASSES, classes)
    found = map_texts(docs.select("text", "learn", "class"), run, ", ".join(["word string", *(f"{n} long" for n in names)]), limit=limit)
    return found.groupBy("word").agg(*(F.sum(n).alias(n) for n in names))


def piece_logp(counts: DataFrame, path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of the pieces: the vocabulary's scores as a prior and expected counts over the words learnt."""
    table = pieces(path)
    logp = np.log(table.start)
    learnt = counts.filter("c > 0").select("word")
    for _ in range(rounds):
        def run(batches, logp=logp):
            own = pieces(path)
            total = np.zeros(len(own.names))
            for batch in batches:
                for words in chunks(batch.column("word").to_pylist()):
                    total += Lattice(words, own).expected(logp, len(own.names))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used])})

        found = learnt.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = prior * table.start
        n[found["piece"].to_numpy()] += found["n"].to_numpy()
        logp = np.log(n / n.sum() * (1 - BYTE_MASS))
    return logp


def log_sum(x: Column, log_y: Column) -> Column:
    """ln(max(x, 0) + y) from x and ln y, which may be far below the smallest double's."""
    log_x = F.ln(x)
    high, low = F.greatest(log_x, log_y), F.least(log_x, log_y)
    return F.when(x > 0, high + F.log1p(F.exp(low - high))).otherwise(log_y)


@dataclass
class Smoothing:
    total: int                # N, tokens learnt, ends included
    kinds: int                # V
    discount: float
    strength: float

    def log_share(self, c: Column, log_g: Column) -> Column:
        """ln P(w) of a word with count c and lattice log probability log_g."""
        return log_sum(c - F.lit(self.discount), F.lit(math.log(self.strength + self.discount * self.kinds)) + log_g) - F.lit(math.log(self.total + self.strength))

    def base(self, c: Column) -> Column:
        return F.log10((c + F.lit(0.1)) / F.lit(self.total + 0.1 * (self.kinds + 1)))


def smoothing(scored: DataFrame, texts: int) -> Smoothing:
    """Discount and strength with the largest leave-one-out likelihood of the counts (word, c, log_g)."""
    learnt = scored.filter("c > 0")
    n, v = learnt.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + texts, v + (texts > 0)
    if n < 2:
        return Smoothing(n, v, 0.0, 1.0)
    trials = [(d, t) for d in DISCOUNTS for t in STRENGTHS]
    fits = learnt.agg(*[F.sum(F.col("c") * (log_sum(F.col("c") - 1 - F.lit(d), F.lit(math.log(t + d * v)) + F.col("log_g")) - F.lit(math.log(n - 1 + t))))
                        for d, t in trials]).first()
    best = max(range(len(trials)), key=lambda k: -math.inf if fits[k] is None or math.isnan(fits[k]) else fits[k])
    return Smoothing(n, v, *trials[best])


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series eight steps up."""
    x = np.asarray(x, float)
    steps_down = sum(np.log(x + k) for k in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7) - steps_down


def lgamma_column(x: Column) -> Column:
    down = F.ln(x)
    for k in range(1, 8):
        down = down + F.ln(x + k)
    z = x + 8
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z) - down


def rising(p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """ln of BURST p (BURST p + 1) ... over `times` factors."""
    return log_rising(np.log(p), times)


def log_rising(log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The same from ln p; only the first factor needs p beyond the range of doubles."""
    out = math.log(BURST) + log_p
    more = times > 1
    a = np.exp(out[more])
    out[more] += lgamma(a + times[more].reshape(-1, *[1] * (log_p.ndim - 1))) - lgamma(a + 1)
    return out


def class_numbers(rows: DataFrame) -> tuple[dict, dict]:
    """Numbers and sizes of all classes of the learning texts; texts without a label (null) are a class of their own."""
    found = rows.filter("learn").groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").collect()
    return {r["class"]: k for k, r in enumerate(found)}, {r["class"]: r["n"] for r in found}


def lm_score(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None,
             head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `class_col` is read from learning texts only; the class of the text that is scored stays unknown.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.monotonically_increasing_id().alias("row_no"), (F.col(class_col) if class_col else F.lit(None)).cast("string").alias("class"))
    number, sizes = class_numbers(rows) if class_col else ({}, {})
    classes = max(1, len(number))
    own = F.lit(number.get(None)).cast("int")
    named = [F.lit(x) for name, k in number.items() if name is not None for x in (name, k)]
    if named:
        own = F.coalesce(F.try_element_at(F.create_map(*named), F.col("class")), own)
    rows = rows.withColumn("class", own)
    head, batch_bytes = (max(1, n * CLASSES // max(CLASSES, classes)) if n else 0 for n in (head, BATCH_BYTES))
    counts = written(word_counts(rows, classes))
    logp = piece_logp(counts, path, rounds)
    names = [f"c{k}" for k in range(classes)]

    def lattice(batches):
        table = pieces(path)
        for batch in batches:
            found = [Lattice(words, table).marginal(logp) for words in chunks(batch.column("word").to_pylist())]
            log_g = math.log(1 - END_SHARE) + np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("word", "c", *names)} | {"log_g": pa.array(log_g)})

    scored = written(counts.mapInArrow(lattice, ", ".join(["word string", "c long", *(f"{n} long" for n in names), "log_g double"])))
    texts = rows.filter("learn").count()
    rule = smoothing(scored, texts)
    held = [sizes[name] for name in number] or [0]
    words_of = scored.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in names)).first()
    total = [int(w) + n for w, n in zip(words_of, held)]

    def log_shares(c: list[Column], all_c: Column, log_g: Column) -> list[Column]:
        plain = rule.log_share(all_c, log_g)
        return [log_sum(F.lit(OWN / n) * one, F.lit(math.log(1 - OWN)) + plain) if n else plain for one, n in zip(c, total)]

    probability = [p.alias(f"p{k}") for k, p in enumerate(log_shares([F.col(n) for n in names], F.col("c"), F.col("log_g")))]
    priced = scored.select("word", (F.col("c") > 0).cast("int").alias("known"), rule.base(F.col("c")).alias("base"), "c", *probability)
    # the most frequent words, all counts of one power of two or none, at most `head` of them
    found = sorted(((r["k"], r["n"]) for r in scored.filter("c > 0").groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, taken = None, 0
    for k, n in found:
        if taken + n > head:
            break
        least, taken = 2 ** k, taken + n
    columns = [f"p{k}" for k in range(classes)]
    top = (priced.filter(F.col("c") >= least) if least else priced.filter("false")).select("word", "base", *columns).toArrow()
    shared = spark.sparkContext.broadcast((top["word"].combine_chunks(), top["base"].to_numpy(), np.stack([top[c].to_numpy() for c in columns], axis=1)))
    end = spark.range(1).select(rule.base(F.lit(texts)), *log_shares([F.lit(n) for n in held], F.lit(texts), F.lit(math.log(END_SHARE)))).first()
    end_log = [math.log(BURST) + p for p in end[1:]]
    prior = [math.log((n + 1) / (sum(held) + len(held))) for n in held]
    logs = [f"l{k}" for k in range(classes)]

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = flat(batch.column("text"))
        words = Words(fold(data), offsets)
        vocabulary = words.vocabulary.cast(pa.string())
        head_word, head_base, head_p = shared.value
        n, wide = batch.num_rows, max(1, len(vocabulary))
        pair, times = np.unique(words.row_of() * wide + words.codes, return_counts=True)
        place = pc.index_in(vocabulary, value_set=head_word).fill_null(-1).to_numpy(zero_copy_only=False)[pair % wide]
        hit = place >= 0
        row, often, place = pair[hit] // wide, times[hit], place[hit]
        grown = log_rising(head_p[place], often)
        size = words.count + 1
        spread = lgamma(size + BURST) - lgamma(np.full(n, BURST))
        rest, rest_times = pair[~hit], times[~hit]
        row_no = batch.column("row_no")

        def both(per_text, kind):
            per_text = pa.array(per_text, kind) if isinstance(per_text, np.ndarray) else per_text
            return pa.concat_arrays([per_text, pa.nulls(len(rest), per_text.type)])

        ends = pa.array([f" {k}" for k in row_no.to_pylist()], pa.string())       # no word holds a space
        out = {"row_no": pa.concat_arrays([row_no, row_no.take(pa.array(rest // wide))]),
               "word": pa.concat_arrays([ends, vocabulary.take(pa.array(rest % wide))]),
               "times": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(rest_times, pa.int64())]),
               "id": both(batch.column("id"), None), "learn": both(batch.column("learn"), None), "n_tokens": both(size, pa.int64()),
               "known": both(np.bincount(row, weights=often, minlength=n).astype(np.int64) + (texts > 0), pa.int64()),
               "base": both(np.bincount(row, weights=often * head_base[place], minlength=n) + end[0], pa.float64())}
        return out | {name: both(np.bincount(row, weights=grown[:, k], minlength=n) + end_log[k] + prior[k] - spread, pa.float64())
                      for k, name in enumerate(logs)}

    stream = map_texts(rows.drop("class"), run, f"row_no long, word string, times long, id {kind}, learn boolean, n_tokens long, known long, base double, "
                       + ", ".join(f"{n} double" for n in logs), limit=batch_bytes)
    rare = (priced.filter(F.col("c") < least) if least else priced).select("word", F.col("known").alias("w_known"), F.col("base").alias("w_base"), *columns)
    joined = stream.join(rare, "word", "left")

    def grown_column(p):
        log_a = F.lit(math.log(BURST)) + F.col(p)
        a = F.exp(log_a)
        return log_a + F.when(F.col("times") == 1, F.lit(0.0)).otherwise(lgamma_column(a + F.col("times")) - lgamma_column(a + 1))

    def text_and_words(name, of_word):
        return (F.max(name) + F.coalesce(F.sum(of_word), F.lit(0))).alias(name)
    sums = joined.groupBy("row_no").agg(
        F.max("id").alias("id"), F.max("learn").alias("learn"), F.max("n_tokens").alias("n_tokens"),
        text_and_words("known", F.col("times") * F.col("w_known")), text_and_words("base", F.col("times") * F.col("w_base")),
        *(text_and_words(name, grown_column(p)) for name, p in zip(logs, columns)))
    best = F.greatest(*logs) if classes > 1 else F.col(logs[0])
    every = sum((F.exp(F.col(name) - best) for name in logs), F.lit(0.0))
    return sums.select(F.col("id").alias(id_col), "learn", "n_tokens", F.col("known").cast("long").alias("n_known"),
                       F.lit(rule.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
                       ((best + F.ln(every)) / F.lit(math.log(10))).alias("score"))
