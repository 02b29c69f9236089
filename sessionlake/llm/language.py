"""The language of documents and passages by a linear-chain conditional random field over words.

Words are labelled with one of the languages of the reference samples. A word's emission is the sum of
the weights of its lexicon entry, affixes and character n-grams; learned transitions tie neighbours.
Training is batch gradient ascent (Adam) on the conditional log-likelihood of the samples, of their
spellings without accents, and of code-switched sequences put together from sentences of several
samples; forward-backward gives the marginals in training and in use. Identifiers, paths and numbers are
left out of the sequences: they belong to no language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists

#: Rows of labelled samples that training reads at most; more are left out by the order of a hash of their text.
MOST_SAMPLES = 4000
BUCKETS = 1 << 15
#: Words below which a document is too short to tell, and a block too short to be a passage.
FEW_WORDS, LEAST_WORDS = 6, 3

# Names of languages in labels, by two-letter code.
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"), "nl": ("nl", "nld", "dut", "dutch"), "ru": ("ru", "rus", "russian"), "ja": ("ja", "jpn", "japanese"),
    "it": ("it", "ita", "italian"), "pl": ("pl", "pol", "polish"), "zh": ("zh", "zho", "chi", "chinese"), "ko": ("ko", "kor", "korean"),
    "sv": ("sv", "swe", "swedish"), "da": ("da", "dan", "danish"), "tr": ("tr", "tur", "turkish"), "uk": ("uk", "ukr", "ukrainian"), "ar": ("ar", "ara", "arabic"),
}
_CODE_OF = {name: code for code, names in NAMES.items() for name in names}

_NEUTRAL = re.compile(r"https?://\S+|[A-Za-z0-9_.@:=#+~-]*(?:[A-Za-z0-9][_/@:=\\]+[A-Za-z0-9_.]|[a-z][A-Z]|\d|\.[a-z]{1,4}\b(?=\W|$))[A-Za-z0-9_./:@=#+~\\-]*|`[^`\n]*`")
_WORDS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々ー]{1,5}|[^\W\d_]+(?:['’][^\W\d_]+)*")
_FENCE = re.compile(r"^[^\S\n]*(?:>[^\S\n]*)*(```|~~~).*?(?:^[^\S\n]*(?:>[^\S\n]*)*\1[^\S\n]*$|\Z)", re.M | re.S)
#: A line that is no prose: heading, table, rule, code by indentation, log, shell prompt, test report or stack trace.
_NOT_PROSE = re.compile(
    r"#{1,6}\s|\||[-=*_]{3,}\s*$|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:\$|>>>|%)\s\S|(?:PASS|FAIL|ok)\s+\S+/\S|at\s+\S+\(|Traceback|File \"|[{}()\[\]<>;]+$"
)
_MARKER = re.compile(r"(?:[-*+•]|\d+[.)])\s+(?:\[[ xX]\]\s)?")
_MARKS = set("#|-=*_[$>%PFoaT{}()]<;") | set("0123456789")

def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names, by code or English name, in any case, with or without a region."""
    if not label or not label.strip():
        return None
    head = re.split(r"[-_ (]", label.strip().lower(), maxsplit=1)[0]
    return _CODE_OF.get(head) or (head if re.fullmatch(r"[a-z]{2}", head) else None)


def blocks(text: str) -> list[list[str]]:
    """The prose of each block between blank lines, as words cut at white space.

    Quotes and lists come without their marks; headings, code, tables and logs are left out.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\u2028" in text or "\u2029" in text:
        text = text.replace("\u2028", "\n").replace("\u2029", "\n\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    out: list[list[str]] = []
    current: list[str] = []
    listed = False
    for line in text.split("\n"):
        body = line.strip()
        while body[:1] == ">" and not body.startswith(">>>"):
            body = body[1:].lstrip()
        if not body:
            if current:
                out.append(current)
                current = []
            listed = False
            continue
        if body[0] in _MARKS:
            if _NOT_PROSE.match(body):
                continue
            if m := _MARKER.match(body):
                listed, body = True, body[m.end() :]
        if line[:1] in "\t " and (line[0] == "\t" or line.startswith("    ")) and not listed:
            continue
        current += body.split()
    if current:
        out.append(current)
    return out


def _token_words(token: str) -> list[str]:
    """The words of a run without white space that a language can claim, in small letters; none for an identifier, path or number."""
    if token.isascii():
        if token.isalpha():
            return [token.lower()] if token.isupper() or token[1:].islower() or len(token) == 1 else []
    else:
        token = unicodedata.normalize("NFC", token)
    return _WORDS.findall(_NEUTRAL.sub(" ", token).lower())


def words_of(text: str) -> list[str]:
    """The words of ``text`` that a language can claim."""
    return [w for token in text.split() for w in _token_words(token)]


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss")


def features(word: str) -> list[int]:
    """Hashed features of a word: lexicon entry, affixes, n-grams, script and accents."""
    plain = word if word.isascii() else _plain(word)
    named = {f"w:{word}", f"l:{plain}"}
    named |= {f"p{n}:{plain[:n]}" for n in (1, 2, 3) if len(plain) > n} | {f"s{n}:{plain[-n:]}" for n in (1, 2, 3, 4) if len(plain) > n}
    edged = f"^{word}$"
    named |= {f"3:{edged[i:i + 3]}" for i in range(len(edged) - 2)} | {f"2:{edged[i:i + 2]}" for i in range(len(edged) - 1)}
    first = ord(word[0])
    named.add("script:" + ("kana" if 0x3040 <= first <= 0x30FF or 0xFF66 <= first <= 0xFF9F else "han" if 0x3400 <= first <= 0x9FFF else "cyrillic" if 0x400 <= first <= 0x52F else "latin" if first < 0x250 else "other"))
    named |= {f"c:{c}" for c in word if ord(c) > 127}
    return sorted({zlib.crc32(x.encode()) % BUCKETS for x in named})


@dataclass
class Crf:
    """Weights of the field: ``emission`` (features by languages), ``transition`` and ``start``."""

    languages: tuple[str, ...]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    def scores(self, word: str) -> np.ndarray:
        return self.emission[features(word)].sum(axis=0)


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    grid = np.zeros((len(sequences), int(lengths.max())), dtype=np.int64)
    for i, s in enumerate(sequences):
        grid[i, : len(s)] = s
    return grid, lengths


def forward_backward(potentials: np.ndarray, transition: np.ndarray, start: np.ndarray, lengths: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Marginals of padded sequences from exponentiated emissions ``(sequence, position, label)``.

    Returns the marginals, with ``edges`` the expected transitions, and the log of the partition functions.
    """
    n, t, k = potentials.shape
    alpha = np.empty((t, n, k), dtype=potentials.dtype)
    scale = np.ones((t, n), dtype=potentials.dtype)
    step = np.ascontiguousarray(potentials.transpose(1, 0, 2))
    current = start * step[0]
    for i in range(t):
        if i:
            current = (current @ transition) * step[i]
        scale[i] = current.sum(axis=1)
        current /= scale[i][:, None]
        alpha[i] = current
    beta = np.ones((n, k), dtype=potentials.dtype)
    marginals = np.empty((n, t, k), dtype=potentials.dtype)
    expected = np.zeros((k, k)) if edges else None
    for i in range(t - 1, -1, -1):
        inside = i < lengths
        both = alpha[i] * beta
        marginals[:, i] = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-30)
        if i:
            onward = step[i] * beta
            if edges:
                weight = np.where(inside, 1.0 / scale[i], 0.0)
                expected += transition * (alpha[i - 1].T @ (onward * weight[:, None]))
            back = onward @ transition.T
            back /= np.maximum(back.sum(axis=1, keepdims=True), 1e-30) if not edges else scale[i][:, None]
            beta = np.where(inside[:, None], back, beta)
    valid = np.arange(t)[:, None] < lengths
    return marginals, expected, (np.log(np.maximum(scale, 1e-300)) * valid).sum(axis=0)


def train(samples: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15, prior: float = 1e-3, seed: int = 7) -> Crf:
    """A field for ``samples`` of (language, text); without any it knows no language and finds none.

    Repeatable: the same samples give the same weights.
    """
    languages = tuple(sorted({lang for lang, text in samples if words_of(text)}))
    if not languages:
        return Crf((), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((0, 0)), np.zeros(0))
    index = {lang: i for i, lang in enumerate(languages)}
    known: dict[str, int] = {}
    number = lambda ws: [known.setdefault(w, len(known)) for w in ws]
    sequences, labels, sentences = [], [], []
    for lang, text in sorted(samples):
        if lang not in index:
            continue
        for version in dict.fromkeys((text, _plain(text))):
            ids = number(words_of(version))
            if ids:
                sequences.append(np.array(ids))
                labels.append(np.full(len(ids), index[lang]))
            for s in re.split(r"(?<=[.!?。])\s*", version):
                if part := number(words_of(s)):
                    sentences.append((index[lang], part))
    rng = np.random.default_rng(seed)
    for _ in range(2 * len(sequences)):
        picks = rng.integers(0, len(sentences), size=int(rng.integers(2, 6)))
        sequences.append(np.concatenate([sentences[p][1] for p in picks]))
        labels.append(np.concatenate([np.full(len(sentences[p][1]), sentences[p][0]) for p in picks]))
    grid, lengths = _padded(sequences)
    truth, _ = _padded(labels)
    k, vocabulary = len(languages), list(known)
    lists = [features(w) for w in vocabulary]
    wide = max(map(len, lists))
    table = np.full((len(lists), wide), BUCKETS)
    for i, f in enumerate(lists):
        table[i, : len(f)] = f
    mask = np.arange(grid.shape[1])[None, :] < lengths[:, None]
    gold_emission = np.zeros((len(vocabulary), k))
    np.add.at(gold_emission, (grid[mask], truth[mask]), 1.0)
    inner = mask[:, 1:]
    gold_transition = np.zeros((k, k))
    np.add.at(gold_transition, (truth[:, :-1][inner], truth[:, 1:][inner]), 1.0)
    flat = table.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] < BUCKETS]
    touched, first = np.unique(flat[order], return_index=True)
    owner = order // wide
    weights = {"e": np.zeros((BUCKETS + 1, k)), "t": np.zeros((k, k)), "s": np.zeros(k)}
    moments = {x: (np.zeros_like(w), np.zeros_like(w)) for x, w in weights.items()}
    total = mask.sum()
    for r in range(1, rounds + 1):
        scores = weights["e"][table].sum(axis=1)
        shifted = scores - scores.max(axis=1, keepdims=True)
        potentials = np.exp(np.maximum(shifted, -30.0))[grid]
        potentials[~mask] = 1.0
        start, moves = np.exp(weights["s"] - weights["s"].max()), np.exp(weights["t"] - weights["t"].max())
        marginals, expected, _ = forward_backward(potentials, moves, start, lengths, edges=True)
        model = np.zeros((len(vocabulary), k))
        for c in range(k):
            model[:, c] = np.bincount(grid[mask], weights=marginals[..., c][mask], minlength=len(vocabulary))
        per_word = gold_emission - model
        slope = np.zeros_like(weights["e"])
        slope[touched] = np.add.reduceat(per_word[owner], first, axis=0)
        gradients = {
            "e": slope / total * k - prior * weights["e"],
            "t": (gold_transition - expected) / total * k - prior * weights["t"],
            "s": (np.bincount(truth[:, 0], minlength=k) - marginals[:, 0].sum(axis=0)) / len(sequences) - prior * weights["s"],
        }
        for x, g in gradients.items():
            m, v = moments[x]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[x] += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(languages, weights["e"][:BUCKETS].astype(np.float32), weights["t"], weights["s"])


class Tagger:
    """Labels blocks in batches; the words of a token and the emission of a word are computed once."""

    def __init__(self, crf: Crf, kept_tokens: int = 300_000):
        self.crf, self.kept = crf, kept_tokens
        self.start = np.exp(crf.start - crf.start.max(initial=0.0)).astype(np.float32)
        self.moves = np.exp(crf.transition - crf.transition.max(initial=0.0)).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.crf.languages)), dtype=np.float32)

    def _row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            s = self.crf.scores(word)
            self.table[at] = np.exp(np.maximum(s - s.max(), -12.0))
        return at

    def numbers(self, tokens: list[str]) -> list[int]:
        """The rows of the words of ``tokens`` in the table of emissions."""
        known = self.tokens
        for t in set(tokens).difference(known):
            known[t] = tuple(map(self._row, _token_words(t)))
        return list(chain.from_iterable(map(known.__getitem__, tokens)))

    def marginals(self, numbered: list[list[int]], chunk: int = 1024):
        """For each list of rows, in the order of length, its index and the marginals of its words."""
        order = sorted((i for i, ids in enumerate(numbered) if ids), key=lambda i: len(numbered[i]))
        for a in range(0, len(order), chunk):
            some = order[a : a + chunk]
            grid, lengths = _padded([np.array(numbered[i]) for i in some])
            potentials = self.table[grid]
            potentials[np.arange(grid.shape[1])[None, :] >= lengths[:, None]] = 1.0
            found, _, _ = forward_backward(potentials, self.moves, self.start, lengths)
            for row, i in enumerate(some):
                yield i, found[row, : lengths[row]]

    def languages_of(self, numbered: list[list[int]], chunk: int = 1024) -> list[tuple[str, float] | None]:
        """The language that holds most of each list's words, by summed marginals, and its mean marginal."""
        out: list[tuple[str, float] | None] = [None] * len(numbered)
        names = self.crf.languages
        for i, m in self.marginals(numbered, chunk):
            share = m.mean(axis=0)
            best = int(share.argmax())
            out[i] = (names[best], float(share[best]))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """Runs of words of one language: first word, end, language and mean marginal."""
        out: list[tuple[int, int, str, float]] = []
        for _, m in self.marginals([[self._row(w) for w in words]]):
            out = self.runs(m)
        return out

    def runs(self, m: np.ndarray, least: int = 1) -> list[tuple[int, int, str, float]]:
        """The runs of the likeliest languages of marginals; one of fewer than ``least`` words joins its more likely neighbour."""
        best = m.argmax(axis=1)
        cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
        held = [[a, b, int(best[a])] for a, b in zip(cuts, cuts[1:])]
        while len(held) > 1 and (short := min(range(len(held)), key=lambda i: held[i][1] - held[i][0])) >= 0 and held[short][1] - held[short][0] < least:
            a, b, _ = held[short]
            beside = [i for i in (short - 1, short + 1) if 0 <= i < len(held)]
            into = max(beside, key=lambda i: float(m[a:b, held[i][2]].sum()))
            held[into] = [min(a, held[into][0]), max(b, held[into][1]), held[into][2]]
            del held[short]
            for i in range(len(held) - 1, 0, -1):
                if held[i][2] == held[i - 1][2]:
                    held[i - 1][1] = held[i][1]
                    del held[i]
        return [(a, b, self.crf.languages[k], float(m[a:b, k].mean())) for a, b, k in held]


def train_from(samples: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST_SAMPLES) -> Crf:
    """A field trained on at most ``most`` labelled rows, taken in the order of a hash of the text; null and blank rows are left out."""
    rows = samples.where(F.col(lang).isNotNull() & (F.trim(text) != "")).select(lang, text).distinct().orderBy(F.xxhash64(text), text).limit(most).collect()
    return train([(r[0], r[1]) for r in rows])


def _told_passages(tagger: Tagger, texts: list[str | None]) -> list[tuple[int, int, str, float, int]]:
    """Index of the text, number of the passage, language, confidence and words, for the passages of each text."""
    if not tagger.crf.languages:
        return []
    if len(tagger.tokens) > tagger.kept:
        tagger._forget()
    owners, lists = [], []
    for i, text in enumerate(texts):
        found = [ids for tokens in (blocks(text) if text else []) if len(ids := tagger.numbers(tokens)) >= LEAST_WORDS]
        if sum(map(len, found)) > FEW_WORDS:
            owners += [(i, n) for n in range(1, len(found) + 1)]
            lists += found
    return [(i, n, told[0], told[1], len(ids)) for (i, n), ids, told in zip(owners, lists, tagger.languages_of(lists))]


def passages(df: DataFrame, key: str, text: str, crf: Crf) -> DataFrame:
    """``key, passage_no, lang, confidence, n_words``: a row for each prose block of three words or more.

    passage_no counts those blocks from 1. Null, empty and wordless texts give no row; documents of fewer
    than seven words give none either, being too short to tell. Repeated rows give repeated results; other
    columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(crf)  # of fixed size: BUCKETS rows of weights

    def make():
        tagger = Tagger(shared.value)

        def run(rows: dict) -> dict:
            out: dict[str, list] = {key: [], "passage_no": [], "lang": [], "confidence": [], "n_words": []}
            for i, n, lang, sure, size in _told_passages(tagger, rows["_text"]):
                for name, value in ((key, rows[key][i]), ("passage_no", n), ("lang", lang), ("confidence", round(sure, 6)), ("n_words", size)):
                    out[name].append(value)
            return out

        return run

    return map_lists(df.select(key, F.col(text).alias("_text")), make, f"`{key}` {kind}, passage_no int, lang string, confidence double, n_words int")


def passage_segments(df: DataFrame, key: str, text: str, crf: Crf) -> DataFrame:
    """``key, passage_no, segment_no, word_start, word_end, lang, confidence, segment_text``: the runs of one language in each passage of ``passages``.

    Words are counted from 0 over the passage, its white space cut as single spaces; a passage in one language
    is one segment. A run of fewer than three words, such as a borrowed term, joins its neighbour. The
    confidence is the mean marginal of the language over the run. Cases as in ``passages``.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(crf)
    columns = ("passage_no", "segment_no", "word_start", "word_end", "lang", "confidence", "segment_text")

    def make():
        tagger = Tagger(shared.value)

        def run(rows: dict) -> dict:
            out: dict[str, list] = {c: [] for c in (key, *columns)}
            if not tagger.crf.languages:
                return out
            if len(tagger.tokens) > tagger.kept:
                tagger._forget()
            owners, tokens, lists = [], [], []
            for i, found in enumerate(rows["_text"]):
                mine = [(part, ids) for part in (blocks(found) if found else []) if len(ids := tagger.numbers(part)) >= LEAST_WORDS]
                if sum(len(ids) for _, ids in mine) > FEW_WORDS:
                    owners += [(i, n) for n in range(1, len(mine) + 1)]
                    tokens += [part for part, _ in mine]
                    lists += [ids for _, ids in mine]
            runs = {at: tagger.runs(m, LEAST_WORDS) for at, m in tagger.marginals(lists)}
            for at, (i, n) in enumerate(owners):
                # a token may have no word or several; a segment begins at the token of its first word
                owner = [t for t, token in enumerate(tokens[at]) for _ in tagger.tokens[token]]
                starts = [0, *(owner[a] for a, *_ in runs[at][1:]), len(tokens[at])]
                for no, (a, b, (_, _, lang, sure)) in enumerate(zip(starts, starts[1:], runs[at]), 1):
                    for c, v in zip((key, *columns), (rows[key][i], n, no, a, b, lang, round(sure, 6), " ".join(tokens[at][a:b]))):
                        out[c].append(v)
            return out

        return run

    return map_lists(df.select(key, F.col(text).alias("_text")), make, f"`{key}` {kind}, passage_no int, segment_no int, word_start int, word_end int, lang string, confidence double, segment_text string")


def unlabelled_languages(df: DataFrame, key: str, text: str, label: str, crf: Crf) -> DataFrame:
    """``key, lang, n_passages, confidence``: each language that holds a whole passage and that ``label`` does not name.

    Cases as in ``passages``. The result needs no shuffle: a document's passages are counted where it is read.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(crf)

    def make():
        tagger = Tagger(shared.value)

        def run(rows: dict) -> dict:
            out: dict[str, list] = {key: [], "lang": [], "n_passages": [], "confidence": []}
            held: dict[tuple[int, str], list[float]] = {}
            for i, _, lang, sure, _ in _told_passages(tagger, rows["_text"]):
                held.setdefault((i, lang), []).append(sure)
            for (i, lang), sure in held.items():
                if label_code(rows["_label"][i]) != lang:
                    out[key].append(rows[key][i])
                    out["lang"].append(lang)
                    out["n_passages"].append(len(sure))
                    out["confidence"].append(round(max(sure), 6))
            return out

        return run

    return map_lists(df.select(key, F.col(text).alias("_text"), F.col(label).alias("_label")), make, f"`{key}` {kind}, lang string, n_passages int, confidence double")


def document_languages(passage_rows: DataFrame, key: str) -> DataFrame:
    """``key, lang, confidence, n_passages``: the language with most words over a document's passages and its share of them."""
    by_language = passage_rows.groupBy(key, "lang").agg(F.sum("n_words").alias("_words"), F.sum(F.col("confidence") * F.col("n_words")).alias("_sure"), F.count("*").alias("_n"))
    total = F.sum("_words")
    return by_language.groupBy(key).agg(
        F.max(F.struct("_words", F.col("lang"))).getField("lang").alias("lang"),
        F.round(F.max_by("_sure", F.struct("_words", "lang")) / total, 6).alias("confidence"),
        F.sum("_n").alias("n_passages"),
    )


def with_short_documents(languages: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """``document_languages`` with a row for each document of ``df``, those without passages included.

    Such a text, too short to tell or without prose, is English where it has a letter and of no language
    (null) where it has none; its confidence is 0, nothing having been weighed, and it has no passages.
    """
    every = df.groupBy(F.col(key).alias("_key")).agg(F.max(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).alias("_worded"))
    told = F.col("n_passages").isNotNull()
    return every.join(languages, F.col("_key").eqNullSafe(F.col(key)), "left").select(
        F.col("_key").alias(key),
        F.when(told, F.col("lang")).when(F.col("_worded"), "en").alias("lang"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
    )
