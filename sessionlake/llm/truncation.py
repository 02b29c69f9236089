"""Outputs that were cut on the way into the store.

Size limits are found from the data: discrete hazards of the length (the share of texts at least that
long that end right there) come from window functions over the lengths alone, each is tested against the
hazards around it, and false discoveries are controlled over all lengths of all sources. The texts are
then read once: one that ends at a significant length is looked at for an incomplete end, and a length
counts as a limit where its texts are, more often than elsewhere, incomplete. A cut at no fixed length
leaves no hazard, so the same reading gathers what else speaks for one: a notice the cutting program left,
a reported size that the stored text cannot explain, and a JSON document or character that ends in the
middle. Each kind of evidence is named in the result.
"""

from __future__ import annotations

import math

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists
from sessionlake.runtime import checkpoint

#: Verbs of cutting and the units they count, in the languages the tools speak.
_CUT = r"truncated|clipped|elided|omitted|removed|dropped|snipped|abbreviated|shortened|hidden|suppressed|cut|exceeded|gekürzt|abgeschnitten|ausgelassen|tronquée?|coupée?|recortad[oa]|truncad[oa]|omitid[oa]|afgekapt|ingekort|обрезано?|усечено?|省略"
_UNIT = r"lines?|characters?|chars?|bytes?|tokens?|rows?|more|output|remainder|rest|middle|response|content|Ausgabe|Zeilen|Zeichen|sortie|lignes?|salida|líneas?|saída|linhas?|uitvoer|regels?|вывод|строк"
#: A notice stands between brackets or rules, names both, and denies nothing.
_NOTICE = regex.compile(
    r"(?P<open><<<|<|\[|\(|~~|---|…)[^\S\n]*(?:\.\.\.[^\S\n]*)?(?P<body>[^\n<>\[\](){}\"'`~…]{2,80}?)[^\S\n]*(?:\.\.\.[^\S\n]*)?(?P<close>>>>|>|\]|\)|~~|---|…)",
    regex.IGNORECASE,
)
_NAMES_CUT = regex.compile(rf"\b(?:{_CUT})\b|省略", regex.IGNORECASE)
_NAMES_UNIT = regex.compile(rf"\b(?:{_UNIT})\b|\d", regex.IGNORECASE)
_DENIES = regex.compile(r"\b(?:nothing|not|no|never|none|nichts|nicht|rien|nada)\b", regex.IGNORECASE)
_MORE_LINES = regex.compile(r"(?m)^[^\S\n]*(?:…|\.\.\.)[^\S\n]*\+?\d+[^\S\n]+(?:more[^\S\n]+)?(?:lines?|rows?|characters?|chars?|bytes?|tokens?)\b[^\n]{0,12}$")
_BARE = regex.compile(r"(?m)^[^\S\n]*(?:\[(?:…|\.{3})\]|\((?:…|\.{3})\)|<(?:…|\.{3})>)[^\S\n\r]*\r?$")
_HINT = regex.compile(rf"{_CUT}|(?:…|\.\.\.)[^\S\n]*(?:\+?\d|[\])>])", regex.IGNORECASE)
#: Parts of the verbs and marks, one of which every notice has; a plain search for them spares most texts the pattern.
_STEMS = ("trunc", "clipped", "elided", "omit", "removed", "dropped", "snipped", "abbreviated", "shortened", "hidden", "suppress", "cut", "exceeded", "gekürzt", "abgeschnitten", "ausgelassen", "tronqu", "coup", "recort", "afgekapt", "ingekort", "обрезан", "усечен", "省略", "…", "...")
_PAIRS = {"<<<": ">>>", "<": ">", "[": "]", "(": ")", "~~": "~~", "---": "---", "…": "…"}
_PART = regex.compile(r"\"(?:limit|offset|head|tail|max_lines|range|lines|start|end)\"\s*:|\|\s*(?:head|tail)\b|\bsed -n\b|(?:head|tail) -n?\s*\d", regex.IGNORECASE)
_JSON = regex.compile(r'"(?:[^"\\]|\\.)*+(?P<open>"?)|[\[\]{}]', regex.DOTALL)
_TOKEN = regex.compile(r"(?P<path>[\w.@-]*/[\w./@-]+)|(?P<number>\d[\d.,:T+-]*Z?)|(?P<hex>\b(?=\w*\d)[0-9a-f]{6,}\b)|(?P<word>\w+)|(?P<other>\S)")
_FINAL = regex.compile(r"[.!?…。！？:;)\]}>\"'`”»|,%]\s*$")

NOTICE, SIZE, JSON_END, BROKEN_CHAR, LIMIT = 1, 2, 4, 8, 16


def has_notice(text: str) -> bool:
    """A notice of cutting that stands at the end, alone on its line, or in the middle of a torn line."""
    low = text.lower()
    if not any(stem in low for stem in _STEMS) or not _HINT.search(text):
        return False
    if _MORE_LINES.search(text) or _BARE.search(text):
        return True
    for m in _NOTICE.finditer(text, overlapped=True):
        if _PAIRS[m["open"]] != m["close"]:
            continue
        body = m["body"]
        if not _NAMES_CUT.search(body) or not _NAMES_UNIT.search(body) or _DENIES.search(body):
            continue
        rest = text[m.end() :]
        if not rest.strip():
            return True
        before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t.…\r")
        after = rest.split("\n", 1)[0].strip(" \t.…\r")
        if not before and not after or m["open"] == "…":
            return True
    return False


def json_is_open(text: str) -> bool:
    """Whether ``text`` is a JSON document that stops before its brackets or its last string close."""
    body = text.lstrip()
    if body[:1] not in ("{", "[") or not regex.match(r'[\[{]\s*(?:["\[{}\]\d-]|true|false|null|$)', body):
        return False
    depth = 0
    for m in _JSON.finditer(body):
        c = m[0]
        if c[0] == '"':
            if not m["open"]:
                return True
        elif c in "[{":
            depth += 1
        else:
            depth -= 1
            if depth == 0 and m.end() < len(body.rstrip()):
                return False  # something follows the document
    return depth > 0


def _shape(line: str) -> tuple[str, ...]:
    return tuple(m.lastgroup if m.lastgroup != "other" else m[0] for m in _TOKEN.finditer(line))


def ends_incomplete(text: str) -> bool:
    """Whether the last line breaks off: it is a proper prefix of the shape most other lines share, or prose without an end."""
    body = text.rstrip("\r\n")
    if body != text or not body:
        return False
    lines = body.split("\n")
    last = lines[-1].rstrip("\r")
    if not last.strip():
        return False
    others = [x for x in (y.rstrip("\r") for y in lines[:-1]) if x.strip()]
    if len(others) >= 3:
        shapes: dict[tuple[str, ...], int] = {}
        for x in others:
            s = _shape(x)
            shapes[s] = shapes.get(s, 0) + 1
        mine = _shape(last)
        if mine in shapes:
            same = [len(x) for x in others if _shape(x) == mine]
            return len(mine) >= 4 and len(last) < 0.6 * min(same)
        common, count = max(shapes.items(), key=lambda p: p[1])
        if count >= 0.6 * len(others):
            return len(mine) < len(common) and common[: len(mine) - 1] == mine[:-1]
        if any(len(s) > len(mine) >= 2 and s[: len(mine)] == mine and c >= 2 for s, c in shapes.items()) and not _FINAL.search(last):
            return True
    words = last.split()
    if len(words) >= 5 and not _FINAL.search(last) and regex.search(r"[.!?。]\s", body) and regex.fullmatch(r"[\p{L}\p{M}'’-]+", words[-1]):
        return sum(bool(regex.fullmatch(r"[\p{L}\p{M}'’-]+[.,;:!?]?", w)) for w in words) >= 0.6 * len(words)
    return False


def evidence(text: str, reported: int | None, asked: str | None) -> tuple[int, int, int]:
    """Flags of what speaks for a cut, and the size in code points and bytes."""
    chars = len(text)
    stored = chars if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    flags = NOTICE if has_notice(text) else 0
    part = bool(asked and _PART.search(asked))
    breaks = text.count("\n")
    if reported is not None and reported > stored + breaks + max(8, chars - len(text.rstrip())):
        wide = chars + sum(c > "￿" for c in text) if reported in (2 * chars, 2 * chars + 2) or not text.isascii() else chars
        if reported not in (2 * wide, 2 * wide + 2):
            flags |= SIZE
    if text.endswith("�"):
        flags |= BROKEN_CHAR
    if not part and json_is_open(text):
        flags |= JSON_END
    return flags, chars, stored


def is_torn(text: str) -> bool:
    """Whether a text that ends at a possible limit ends there incomplete."""
    return text.endswith("\ufffd") or json_is_open(text) or ends_incomplete(text)


#: The significant lengths of each source and unit.
Lengths = dict[tuple[str | None, str], frozenset[int]]


def _features(df: DataFrame, key: str, groups: list[str], text: str, reported: str, asked: str, lengths: Lengths) -> DataFrame:
    """``key, groups, flags, n_chars, n_bytes, torn``; ``torn`` only of texts that end at a significant length of their source, the first group, or in bytes within three of one."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *groups)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", flags int, n_chars int, n_bytes int, torn boolean"
    shared = df.sparkSession.sparkContext.broadcast(lengths)  # some lengths up to the longest text, whatever the number of texts

    def make():
        near: Lengths = {(source, unit): sizes if unit == "chars" else frozenset(n + d for n in sizes for d in range(-3, 3)) for (source, unit), sizes in shared.value.items()}
        none: frozenset[int] = frozenset()

        def look(rows: dict) -> dict:
            out = {c: rows[c] for c in kinds} | {c: [] for c in ("flags", "n_chars", "n_bytes", "torn")}
            for source, t, n, a in zip(rows[groups[0]], rows["_text"], rows["_reported"], rows["_asked"]):
                flags, chars, stored = evidence(t, n, a)
                at_limit = chars in near.get((source, "chars"), none) or stored in near.get((source, "bytes"), none)
                for c, v in (("flags", flags), ("n_chars", chars), ("n_bytes", stored), ("torn", is_torn(t) if at_limit else None)):
                    out[c].append(v)
            return out

        return look

    source = df.select(key, *groups, F.col(text).alias("_text"), F.col(reported).cast("long").alias("_reported"), F.col(asked).alias("_asked"))
    return map_lists(source.where(F.length("_text") > 0), make, schema)


def length_hazards(features: DataFrame, source: str, reach: int = 40) -> DataFrame:
    """``source, unit, length, ending, at_risk, near_ending, near_at_risk``, one row per length that occurs.

    ``ending / at_risk`` is the discrete hazard: of the texts of at least that length, those that end
    there. The neighbours are the lengths within ``reach``, itself left out. The windows run over
    counts per length, of which a source has at most as many as its longest text has characters.
    """
    long = features.select(source, F.explode(F.create_map(F.lit("chars"), F.col("n_chars"), F.lit("bytes"), F.col("n_bytes"))).alias("unit", "length"))
    counts = long.groupBy(source, "unit", "length").agg(F.count("*").alias("ending"))
    by = Window.partitionBy(source, "unit")
    risk = counts.withColumn("at_risk", F.sum("ending").over(by.orderBy(F.desc("length"))))
    near = by.orderBy("length").rangeBetween(-reach, reach)
    return risk.withColumns({"near_ending": F.sum("ending").over(near) - F.col("ending"), "near_at_risk": F.max("at_risk").over(near)})


def poisson_tail_bound(count: Column, mean: Column) -> Column:
    """The least simple upper bound of P(X >= count) for a Poisson variable, close where the count is far above the mean; 1 where it is not above it.

    The probability of the count itself by Stirling's series, times the geometric sum that bounds the rest.
    """
    log_factorial = count * F.log(count) - count + 0.5 * F.log(2 * math.pi * count) + 1 / (12 * count) - 1 / (360 * F.pow(count, F.lit(3)))
    at_count = F.exp(count * F.log(mean) - mean - log_factorial)
    return F.when((count < 1) | (count <= mean), 1.0).when(mean <= 0, 0.0).otherwise(F.least(F.lit(1.0), at_count * (count + 1) / (count + 1 - mean)))


def unusual_lengths(hazards: DataFrame, source: str, reach: int = 40, rate: float = 0.001, least: int = 5) -> DataFrame:
    """The lengths whose hazard stands out: ``source, unit, limit_length, ending, expected, p_value``.

    Each hazard is tested against the pooled hazard around it (Poisson tail, bounded from above), and the
    p-values go through Benjamini and Hochberg's step-up procedure at ``rate`` over all sources and lengths.
    """
    expected: Column = F.col("at_risk") * F.greatest(F.col("near_ending"), F.lit(0.5)) / (2 * reach * F.greatest(F.col("near_at_risk"), F.lit(1)))
    tested = hazards.withColumn("expected", expected).withColumn("p_value", F.when(F.col("ending") >= least, poisson_tail_bound(F.col("ending").cast("double"), F.col("expected"))).otherwise(F.lit(1.0)))
    # the step-up needs ranks only among the small p-values and the number of all tests
    total = tested.agg(F.count("*").alias("_tests"))
    small = tested.where(F.col("p_value") <= rate)
    ranked = small.withColumn("_rank", F.row_number().over(Window.orderBy("p_value"))).crossJoin(F.broadcast(total))
    passing = F.max(F.when(F.col("p_value") <= rate * F.col("_rank") / F.col("_tests"), F.col("_rank"))).over(Window.partitionBy())
    return ranked.withColumn("_last", passing).where(F.col("_rank") <= F.col("_last")).select(source, "unit", F.col("length").alias("limit_length"), "ending", "expected", "p_value")


def significant_lengths(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``unusual_lengths`` of the texts of ``df``, each record counted once; the texts themselves are only measured."""
    sizes = df.select(key, source, F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes")).where(F.col("n_chars") > 0).dropDuplicates([key])
    return unusual_lengths(length_hazards(sizes, source), source)


def _at_lengths(features: DataFrame, lengths: DataFrame, source: str) -> DataFrame:
    """The features of texts that end at a significant length, once for each, with ``_unit``, ``limit_length`` and ``_exact``.

    A limit in bytes may drop or replace the last, split character: texts with such characters that end
    incomplete within three bytes of it are met too, without being exact.
    """
    named = lengths.select(F.col(source).alias("_source"), F.col("unit").alias("_unit"), "limit_length", "ending", "expected", "p_value")
    size = F.when(F.col("_unit") == "chars", F.col("n_chars")).otherwise(F.col("n_bytes"))
    close = (F.col("_unit") == "bytes") & (F.col("n_bytes") > F.col("n_chars")) & F.col("torn") & F.col("n_bytes").between(F.col("limit_length") - 3, F.col("limit_length") + 2)
    met = features.where(F.col("torn").isNotNull()).join(named, F.col(source).eqNullSafe(F.col("_source")) & ((size == F.col("limit_length")) | close))
    return met.withColumn("_exact", size == F.col("limit_length"))


def found_limits(features: DataFrame, lengths: DataFrame, source: str, torn_share: float = 0.25) -> DataFrame:
    """``source, unit, limit_length, ending, expected, p_value, n_torn``: the significant lengths at which at least ``torn_share`` of the texts are incomplete."""
    exact = _at_lengths(features, lengths, source).where("_exact")
    limits = exact.groupBy("_source", "_unit", "limit_length", "ending", "expected", "p_value").agg(F.count("*").alias("_n"), F.sum(F.col("torn").cast("long")).alias("n_torn"))
    return limits.where(F.col("n_torn") >= torn_share * F.col("_n")).select(F.col("_source").alias(source), F.col("_unit").alias("unit"), "limit_length", "ending", "expected", "p_value", "n_torn")


def cut_at_limits(features: DataFrame, lengths: DataFrame, key: str, source: str, torn_share: float = 0.25) -> DataFrame:
    """``key`` of the texts that end at a limit."""
    limits = found_limits(features, lengths, source, torn_share).select(F.col(source).alias("_s"), F.col("unit").alias("_u"), F.col("limit_length").alias("_l"))
    kept = _at_lengths(features, lengths, source).join(limits, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_unit") == F.col("_u")) & (F.col("limit_length") == F.col("_l")), "left_semi")
    return kept.select(key).distinct()


def measured(df: DataFrame, key: str, source: str, tool: str, text: str, reported: str, asked: str) -> tuple[DataFrame, DataFrame]:
    """The features of each record with a text, one row per key, and the significant lengths; both checkpointed."""
    lengths = checkpoint(significant_lengths(df, key, source, text))
    known: dict[tuple, set[int]] = {}
    for r in lengths.select(source, "unit", "limit_length").collect():  # outliers among the lengths of a few named sources
        known.setdefault((r[0], r[1]), set()).add(r[2])
    features = _features(df, key, [source, tool], text, reported, asked, {at: frozenset(sizes) for at, sizes in known.items()})
    return checkpoint(features.dropDuplicates([key])), lengths


def truncated_outputs(df: DataFrame, key: str, source: str, tool: str, text: str, reported: str, asked: str) -> DataFrame:
    """``key, source, tool, evidence`` (a list of names) and ``is_cut`` for each record, one row per key.

    At a limit every text that ends there counts as cut: one that is whole and just as long cannot be told
    apart. Null and empty texts are not cut and have no evidence; a null reported size says nothing; null
    sources and tools are groups of their own; re-delivered rows count once; other columns are ignored.
    """
    features, lengths = measured(df, key, source, tool, text, reported, asked)
    limited = cut_at_limits(features, lengths, key, source).withColumn("_limited", F.lit(True))
    flags = F.col("flags").bitwiseOR(F.when(F.col("_limited"), F.lit(LIMIT)).otherwise(F.lit(0)))
    names = {LIMIT: "length_limit", NOTICE: "notice", SIZE: "size", JSON_END: "open_json", BROKEN_CHAR: "broken_character"}
    listed = F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(bit)) > 0, F.lit(name)) for bit, name in names.items()]))
    quiet = df.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key, source, tool).dropDuplicates([key]).select("*", F.array().cast("array<string>").alias("evidence"), F.lit(False).alias("is_cut"))
    found = features.join(limited, key, "left").select(key, source, tool, listed.alias("evidence"), (flags > 0).alias("is_cut"))
    return found.unionByName(quiet)


def truncation_rates(found: DataFrame, source: str, tool: str) -> DataFrame:
    """How often each source and tool is cut: ``source, tool, n_calls, n_cut, cut_share``."""
    cut = F.sum(F.col("is_cut").cast("long"))
    return found.groupBy(source, tool).agg(F.count("*").alias("n_calls"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("cut_share"))
