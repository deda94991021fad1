"""Toxicity: noisy-channel deobfuscation under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.shared import reach_workers, read_table, written

#: At most so many labelled rows teach the classifier, chosen by a hash of their ids.
LABELLED_ROWS = 20_000
#: A feature counts if it is in so many toxic documents, and so large a share of the documents with it is toxic.
MIN_TOXIC, MIN_PRECISION = 6, 0.75
#: A beginning of a toxic word is a word of its own if so many clean documents have it.
MIN_COMMON = 2
#: Labelled texts are copies if all minima of one band agree, and so large a share of all minima.
BANDS, BAND_MINIMA, COPY_SHARE = 6, 6, 0.7
#: Tokens that one Python worker remembers.
REMEMBERED = 200_000
#: Characters of texts that are counted or searched at once.
PORTION = 1 << 20

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœß"
#: Which letters a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h"}
SEPARATORS = " .-_*~'"
_BREAKS = frozenset(SEPARATORS)
_A = len(LETTERS) + 1
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Letters with a mark, and the plain letter that each may stand for.
_PLAIN = str.maketrans({c: unicodedata.normalize("NFD", c)[0] for c in LETTERS if len(unicodedata.normalize("NFD", c)) > 1})
_L, _S = LETTERS, re.escape("".join(LOOKALIKES))
_EDGES = re.compile(rf"^[^{_L}{_S}]+|[^{_L}{_S}]+$")
_WORDS = re.compile(rf"[{_L}]+")
#: A token of which every character can stand for itself alone: its lattice has one path, the token.
_ONE_PATH = re.compile(rf"(?:([{_L}])(?!\1))*")
#: Log probability of a dropped separator, of one that ends a word, of a dropped repetition, and of any other dropped character.
_JOIN, _BREAK, _AGAIN, _LOST = -0.1, -1.0, -0.5, -4.0
#: Words of fewer letters are not looked for in joined neighbours.
_JOINED = 4
#: Log probability of a space that is dropped, or ends a word as it should.
_SPACE_JOIN, _SPACE_BREAK = -1.0, -0.5


class _Folded(dict):
    """What a character folds to once compatibility forms are composed: letters of the alphabet stay, other marked letters lose their marks, lone marks and invisible characters go."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        if c not in _NUMBER and base in _NUMBER:
            out = base
        else:
            out = "" if unicodedata.category(c) in ("Mn", "Me", "Cf") else c
        self[code] = out
        return out


_FOLDED = _Folded()
_FOREIGN = re.compile(rf"[^\x00-\x7f{LETTERS}]+")


def folded(text: str | None) -> str:
    """A text in lower case, without compatibility forms (full-width letters and the like), marks beyond the alphabet's and invisible characters."""
    text = text or ""
    return text.lower() if text.isascii() else _FOREIGN.sub(lambda m: m[0].translate(_FOLDED), unicodedata.normalize("NFKC", text).lower())


def portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, so many at once that they have ``PORTION`` characters or more, but for the last."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): letter trigrams of all whole texts, as numbers in base ``len(LETTERS) + 1``; 0 is anything but a letter."""
    reach_workers(docs.sparkSession)
    table = np.zeros(0x250, np.int64)
    for c, i in _NUMBER.items():
        table[ord(c)] = i

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for at in range(0, len(text or ""), PORTION):
                    yield f" {text[max(0, at - 2) : at + PORTION].lower()} "

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_A**3, np.int64)
        for some in portions(pieces(batches)):
            codes = np.frombuffer("".join(some).encode("utf-32-le", "replace"), np.uint32)
            ids = table.take(codes, mode="clip")  # the last place is no letter's
            grams = ids[:-2] * _A * _A + ids[1:-1] * _A + ids[2:]
            ends = np.cumsum([len(x) for x in some])[:-1]
            grams[ends - 1] = grams[ends - 2] = _A**3  # no trigram reaches from one text into the next
            total += np.bincount(grams, minlength=_A**3 + 1)[:-1]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: DataFrame, words: dict[str, float]) -> np.ndarray:
    """Log probabilities of a letter after two others: the corpus's trigrams, half mixed with those of ``words``.

    At most ``len(LETTERS) + 1`` cubed rows come to the driver, whatever the corpus.
    """
    def smooth(counts: np.ndarray) -> np.ndarray:
        cube = counts.reshape(_A, _A, _A) + 0.01
        return cube / cube.sum(axis=2, keepdims=True)

    corpus = np.zeros(_A**3)
    for r in grams.collect():
        corpus[r["gram"]] = r["n"]
    own = np.zeros(_A**3)
    for word, weight in words.items():
        ids = [0, 0, *(_NUMBER.get(c, 0) for c in word), 0]
        for a, b, c in zip(ids, ids[1:], ids[2:]):
            own[a * _A * _A + b * _A + c] += weight
    return np.log(0.5 * smooth(corpus) + 0.5 * smooth(own)).astype(np.float32)


@lru_cache(maxsize=1 << 16)
def _ways(c: str, again: bool) -> tuple[tuple[str, float], ...]:
    repeated = (("", _AGAIN),) if again else ()
    if c in _NUMBER:
        return ((c, 0.0), *repeated)
    found = tuple((x, -0.3 - math.log(len(LOOKALIKES[c]))) for x in LOOKALIKES.get(c, ""))
    if c.isspace():
        return (*found, ("", _SPACE_JOIN), (" ", _SPACE_BREAK))
    if c in SEPARATORS:
        return (*found, ("", _JOIN), (" ", _BREAK))
    return (*found, ("", _LOST), *repeated)


def options(c: str, before: str) -> tuple[tuple[str, float], ...]:
    """What a character may stand for after another, with log probabilities: a letter, nothing (""), or the end of a word (" ")."""
    return _ways(c, c == before)


def restore(token: str, lm: np.ndarray | list) -> str:
    """The likeliest plain words behind a token: Viterbi over a lattice of what each character may stand for.

    A letter stands for itself, or is dropped as a repetition of the letter before; a look-alike stands for one of its letters or is dropped; a separator or a space is dropped or ends a word. States are the last two letters. Paths share
    their beginnings, and where all meet in one state what lies before is settled, so tokens may have any length. ``lm`` is indexed letter by letter, as an array or as nested lists.
    """
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    settled: list[str] = []
    before = ""

    def letters(path: tuple | None) -> str:
        out = []
        while path is not None:
            out.append(path[1])
            path = path[0]
        return "".join(reversed(out))

    for c in token:
        ways = _ways(c, c == before)
        before = c
        if len(best) == 1 and len(ways) == 1 and ways[0][0]:  # one state and one choice: nothing to weigh
            ((_, b),) = best
            settled.append(ways[0][0])
            best = {(b, _NUMBER.get(ways[0][0], 0)): (0.0, None)}
            continue
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, path) in best.items():
            row = lm[a][b]
            for x, cost in ways:
                if x:
                    k = _NUMBER.get(x, 0)
                    state, q = (b, k), p + cost + float(row[k])
                else:
                    state, q = (a, b), p + cost
                if state not in new or q > new[state][0]:
                    new[state] = (q, (path, x) if x else path)
        best = new
        if len(best) == 1:
            ((state, (_, path)),) = best.items()
            settled.append(letters(path))
            best = {state: (0.0, None)}
    _, path = max(((p + float(lm[a][b][0]), path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])
    return "".join(settled) + letters(path)


def features(word: str) -> list[str]:
    """A word and its beginnings of 3 to 6 letters."""
    return [f"{word}$", *(word[:n] for n in range(3, min(6, len(word)) + 1))]


class Decoder:
    """Restores tokens and joined neighbours; each distinct token is restored once and remembered, up to ``REMEMBERED`` of them.

    ``words`` are looked for across neighbouring tokens: a walk over their letters, with the choices of the lattice, tells which
    runs of tokens may hold one, and the character model decides whether the spaces in such a run are dropped. A run does not begin with a word of its own (``common``: three letters or more).

    With ``wanted`` features a token is searched for the likeliest path only if some path through its lattice begins a word with one of them; no other path could change what is found.
    """

    def __init__(self, lm: np.ndarray | None, words: Iterable[str] = (), common: Iterable[str] = (), wanted: Iterable[str] | None = None) -> None:
        self.lm = None if lm is None else lm.tolist()
        self.whole = frozenset(w for w in words if len(w) >= _JOINED)
        self.begun = frozenset(w[:n] for w in self.whole for n in range(1, len(w)))
        self.common = frozenset(common)
        self.wanted = None if wanted is None else frozenset(f.removesuffix("$") for f in wanted)
        self.leading = frozenset(f[:n] for f in self.wanted or () for n in range(1, len(f)))
        self.plain: dict[str, tuple[str, ...]] = {}
        self.known: set[str] = set()
        self.starts: dict[str, frozenset[str]] = {}

    def __call__(self, token: str) -> tuple[str, ...]:
        """The words in a token, as it stands and restored."""
        found = self.plain.get(token)
        if found is None:
            if len(self.plain) > REMEMBERED:
                self.plain.clear()
            found = self.plain[token] = self.words(token)
        return found

    def words(self, token: str) -> tuple[str, ...]:
        if _ONE_PATH.fullmatch(token):
            return (token,)
        found = _WORDS.findall(token)
        core = _EDGES.sub("", token)
        if self.lm is not None and not (len(found) == 1 and core == found[0] and _ONE_PATH.fullmatch(core)) and (self.wanted is None or self.may_hit(core)):
            cores = {core, core.rstrip("!|.,*")}
            found += [w for c in sorted(cores) if c for w in restore(c, self.lm).split()]
        return tuple(dict.fromkeys(found))

    def may_hit(self, token: str) -> bool:
        """Whether a path through the lattice of a token has a word that begins with a wanted feature."""
        states: set[str | None] = {""}  # None: within a word that begins with none
        before, breaks = "", not _BREAKS.isdisjoint(token)
        for c in token:
            ways, new = _ways(c, c == before), set()
            for s in states:
                for x, _ in ways:
                    if x in ("", " "):
                        new.add("" if x else s)
                    elif s is not None and s + x in self.wanted:
                        return True
                    elif s is not None and s + x in self.leading:
                        new.add(s + x)
                    elif breaks:
                        new.add(None)
            if not new:
                return False
            states, before = new, c
        return False

    def walk(self, states: Iterable[str], token: str) -> tuple[frozenset[str], bool]:
        """Where beginnings of words lead over a token's characters, and whether they pass a whole word."""
        before, hit, states = "", False, frozenset(states)
        for c in token:
            states = frozenset(s + x if x != " " else s for s in states for x, _ in options(c, before) if x in ("", " ") or s + x in self.begun or s + x in self.whole)
            hit = hit or not states.isdisjoint(self.whole)
            before = c
            if not states:
                break
        return states, hit

    def start(self, token: str) -> frozenset[str]:
        """Where a run that begins with this token leads; nowhere for most tokens."""
        return frozenset() if token in self.common else self.walk(("",), token)[0] - {""}

    def joined(self, tokens: list[str]) -> Iterator[str]:
        """The words behind runs of neighbouring tokens that may hold a word across their spaces."""
        if not self.whole or self.lm is None:
            return
        distinct = set(tokens)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.starts.clear()
        for token in distinct.difference(self.known):
            if states := self.start(token):
                self.starts[token] = states
        self.known |= distinct
        live = distinct.intersection(self.starts)
        for i in [i for i, t in enumerate(tokens) if t in live] if live else ():
            states, j = self.starts[tokens[i]], i
            while states and j + 1 < len(tokens):
                j += 1
                states, hit = self.walk(states, tokens[j])
                states -= {""}
                if hit:
                    yield from restore(" ".join(tokens[i : j + 1]), self.lm).split()


def restored_words(text: str | None, decoder: Decoder) -> set[str]:
    """The words of a text, those behind disguised tokens and joined neighbours included if there is a model."""
    tokens = folded(text).split()
    return {w for t in set(tokens) for w in decoder(t)}.union(decoder.joined(tokens))


def lattice_pattern(beginnings: Iterable[str]) -> str:
    """A regular expression (RE2) that every folded text matches in which a path through the lattice, over any spaces, begins a word with one of ``beginnings``; others may match as well.

    A word begins a text or follows what is no letter. Each of its letters is written by itself, with a mark or by a look-alike, and between two of them lies nothing but what may be dropped: what is no letter, or the first of them again.
    """
    code = lambda chars: "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars))
    written_as = {x: {c for c in LETTERS if c == x or c.translate(_PLAIN) == x} for x in LETTERS}

    def tree(words: Iterable[str]) -> str:
        branches: dict[str, set[str]] = {}
        for word in words:
            branches.setdefault(word[0], set()).add(word[1:])
        out = []
        for x, rest in sorted(branches.items()):
            out.append(f"[{code(written_as[x].union(c for c, may in LOOKALIKES.items() if x in may))}]")
            if "" not in rest:
                out[-1] += f"[^{code(set(LETTERS) - written_as[x])}]*{tree(rest)}"
        return f"(?:{'|'.join(out)})"

    return f"(?:^|[^{code(LETTERS)}]){tree(beginnings)}"


#: The longest beginnings that texts are searched for, and shorter ones in case that these are too many for a regular expression.
_SEARCHED = (6, 5, 4, 3)


class Scorer:
    """Scores texts from the features that their restored words hit."""

    def __init__(self, precision: dict[str, float], base: float, lm: np.ndarray, common: Iterable[str] = ()) -> None:
        self.precision, self.base, self.lm, self.common = precision, base, lm, tuple(common)
        self.decoder = Decoder(lm, [f[:-1] for f in precision if f.endswith("$")], common, precision)
        self.heads = frozenset(f.removesuffix("$")[:3] for f in precision)
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, ...]] = {}
        self.search = self._search()

    def _search(self) -> str | None:
        """The pattern without which no word of a text hits a feature; None: any text may."""
        for n in _SEARCHED:
            pattern = lattice_pattern({f.removesuffix("$")[:n] for f in self.precision}) if self.precision else r"[^\x{0}-\x{10ffff}]"
            try:
                pc.match_substring_regex(pa.array([""]), pattern)
            except pa.ArrowInvalid:  # too large
                continue
            return pattern
        return None

    def _look(self, words: Iterable[str]) -> tuple[str, ...]:
        found = []
        for word in words:
            if word[:3] not in self.heads:
                continue
            own = [f for f in features(word) if f in self.precision]
            if own:
                found.append(max(own, key=lambda f: (self.precision[f], len(f))))
        return tuple(found)

    def each(self, texts: Iterable[str | None]) -> Iterator[float]:
        """The scores of texts in order. Only texts that match the pattern can hit a feature, so the others are not cut into tokens."""
        for some in portions(map(folded, texts)):
            found = [True] * len(some) if self.search is None else pc.match_substring_regex(pa.array(some, pa.large_string()), self.search).to_pylist()
            for text, may_hit in zip(some, found, strict=True):
                yield self._weighed(self._found(text) if may_hit else ())

    def __call__(self, text: str | None) -> float:
        return self._weighed(self._found(folded(text)))

    def _found(self, text: str) -> set[str]:
        """The features that a folded text hits."""
        tokens = text.split()
        distinct = set(tokens)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.hits.clear()
        for token in distinct.difference(self.seen):
            own = self._look(self.decoder.words(token))
            if not token.isascii() and (plain := token.translate(_PLAIN)) != token:  # marks may be a disguise as well
                own += self._look(self.decoder.words(plain))
            if own:
                self.hits[token] = own
        self.seen |= distinct
        found = {f for t in distinct.intersection(self.hits) for f in self.hits[t]}
        found.update(self._look(self.decoder.joined(tokens)))
        return found

    def _weighed(self, found: Iterable[str]) -> float:
        miss = 1.0 - self.base
        for f in sorted(found):
            miss *= 1.0 - self.precision[f]
        return 1.0 - miss


_LAST: dict[str, Scorer] = {}


def _scorer(name: str, *model) -> Scorer:
    """The scorer of that name, kept by the worker from task to task with the tokens that it has restored."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Scorer(*model)
    return _LAST[name]


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _own_evidence(counts: dict[str, tuple[int, int]]) -> set[str]:
    """Words, and those beginnings of words that are precise beyond their strongest longer feature: "lose" tells nothing that "loser" doesn't."""
    names, kept = sorted(counts), set()
    for i, name in enumerate(names):
        toxic, clean = counts[name]
        longer = (counts[x] for x in takewhile(lambda x: x.startswith(name), islice(names, i + 1, None))) if not name.endswith("$") else ()
        a, b = max(longer, default=(0, 0))
        if name.endswith("$") or (toxic - a) / (toxic - a + max(0, clean - b) + 1) >= MIN_PRECISION:
            kept.add(name)
    return kept


def sketches(sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id, text, toxic) with a hash of each normalised text and ``BANDS`` x ``BAND_MINIMA`` independent minima over its pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(42)
        factors = rng.integers(0, 1 << 63, (BANDS * BAND_MINIMA, 2), np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            whole, minima = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").lower().split()
                whole.append(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "replace"), 42) - (1 << 63))
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {" ".join(words)}
                h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), 42) for x in pairs), np.uint64, len(pairs))
                minima.append(b"".join((((h ^ (h >> np.uint64(29))) * f) ^ g).min().tobytes() for f, g in factors))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2).cast(pa.int32()), pa.array(whole, pa.int64()), pa.array(minima, pa.binary())], names=["doc_id", "text", "toxic", "whole", "minima"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, whole long, minima binary")


def one_per_text(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """(doc_id, whole) of the smallest doc_id in each group of copies among sketches (doc_id, toxic, whole, minima) of one label.

    Texts are copies if they are equal once normalised, or if all minima of a band agree and ``COPY_SHARE`` of all minima do.
    """
    rows = sorted(rows)
    group = list(range(len(rows)))

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[tuple, int] = {}
    vectors = [np.frombuffer(bytes(minima), np.uint64) for *_, minima in rows]
    for i, (_, toxic, whole, minima) in enumerate(rows):
        keys = [(toxic, whole), *((toxic, k, vectors[i][k * BAND_MINIMA : (k + 1) * BAND_MINIMA].tobytes()) for k in range(BANDS))]
        for n, key in enumerate(keys):
            j = first.setdefault(key, i)
            if n == 0 or (vectors[i] == vectors[j]).mean() >= COPY_SHARE:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [(rows[i][0], rows[i][2]) for i in range(len(rows)) if find(i) == i]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS) -> Scorer:
    """A scorer from documents (doc_id, text) and labels (doc_id, toxic 0/1; others are ignored).

    Rows that repeat a doc_id with unlike texts all teach, equal ones once. The character model counts the whole texts of all documents. The classifier learns from at most ``max_rows`` labelled
    rows, drawn by a hash of doc_id: their ids, a table of that bound, are broadcast to the documents, so texts are not
    shuffled. A feature's weight is the smoothed share of toxic ones among the documents that have it, in its restored text.
    """
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # copies of one text would pass its rare words off as evidence: of each group of copies the smallest doc_id teaches
    sample = written(sketches(sample), "sample")
    teachers = one_per_text([tuple(r) for r in sample.select("doc_id", "toxic", "whole", "minima").distinct().collect()])  # about LABELLED_ROWS rows of 300 bytes
    teachers = docs.sparkSession.createDataFrame(teachers, "doc_id long, whole long")
    sample = sample.join(F.broadcast(teachers), ["doc_id", "whole"]).dropDuplicates(["doc_id", "whole"]).select("text", "toxic")
    sample = written(sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism), "lessons")

    def useful(lm: np.ndarray | None, words: Iterable[str] = ()) -> tuple[dict[str, tuple[int, int]], list[str]]:
        words = sorted(words)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by, decoder = (Counter(), Counter()), Decoder(lm, words)
            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by[toxic].update({f for w in restored_words(text, decoder) for f in features(w)})
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][x] for x in names], pa.int64()), pa.array([by[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])

        counted = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        share = F.col("toxic") / (F.col("toxic") + F.col("clean") + 1)
        strong = (F.col("toxic") >= MIN_TOXIC) & (share >= MIN_PRECISION)
        begun = sorted({f"{w[:n]}$" for w in words for n in range(3, len(w))})
        found = counted.filter(strong | F.col("feature").isin(begun) & (F.col("clean") >= MIN_COMMON)).withColumn("strong", strong)
        kept = found.toArrow()  # of the bounded sample: its toxic rows' features / MIN_TOXIC at most, and beginnings of such words
        rows = list(zip(*(kept[c].to_pylist() for c in ("feature", "toxic", "clean", "strong")), strict=True))
        return {f: (a, b) for f, a, b, ok in rows if ok}, sorted(f[:-1] for f, _, _, ok in rows if f in begun)

    grams = written(gram_counts(docs), "grams")
    # the plain words of the labelled texts sharpen the character model; what it restores in them is what the classifier learns from
    first, _ = useful(None)
    words = [f[:-1] for f in sorted(first) if f.endswith("$")]
    lm = language_model(grams, {w: float(first[f"{w}$"][0]) for w in words})
    counts, common = useful(lm, words)
    own = _own_evidence(counts)
    return Scorer({f: a / (a + b + 1) for f, (a, b) in sorted(counts.items()) if f in own}, 0.02, lm, common)


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text: 0 to 1, higher means likelier toxic. Null text scores like empty text.

    Columns pass through with the text, whatever their names; one called ``column`` is replaced. Repeated rows are scored each; an empty table stays empty.
    """
    reach_workers(docs.sparkSession)
    kept = [c for c in docs.columns if c != column]
    model, name = (scorer.precision, scorer.base, scorer.lm, scorer.common), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(name, *model)
        for batch in batches:
            texts = batch.column(kept.index("text"))
            scores = pa.array(own.each(t.as_py() for t in texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, column])

    schema = docs.select(*kept).withColumn(column, F.lit(0.0)).schema
    return docs.select(*kept).mapInArrow(run, schema)


def op7_restored_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_fold(F.col("doc_id")) != 2)
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", (_fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
