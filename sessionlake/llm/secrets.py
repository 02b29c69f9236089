"""Credentials embedded in code, configuration, commands and chat.

An Aho-Corasick automaton over the whole text finds anchors: prefixes of known credential formats,
names that announce a credential, and the phrases that introduce one. At each anchor a small pattern
reads the value that is assigned there. Values in a known hash or identifier format, placeholders and
references to variables, files or secret stores are put aside first. Every other value is segmented by
Viterbi into dictionary words (the alphabetic entries of a public tokenizer's vocabulary, cheaper the
more frequent), and the letters and digits that the words leave unexplained decide: a value with a long
enough residual is a credential. Under a password's name four words written as one are a passphrase.
"""

from __future__ import annotations

import math
import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists

# Prefixes and forms of credentials that issuers publish.
FORMATS = {
    "aws_key_id": r"A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{40,}",
    "gitlab_token": r"glpat-[\w-]{20,}",
    "slack_token": r"xox[abeoprs]-[\w-]{10,}",
    "payment_key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "model_key": r"sk-[A-Za-z0-9_-]{20,}",
    "google_key": r"AIza[\w-]{33,}",
    "package_token": r"npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}",
    "hub_token": r"hf_[A-Za-z0-9]{30,}",
    "mail_key": r"SG\.[\w-]{16,}\.[\w-]{16,}",
    "jwt": r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
}
_FORMAT_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxe-", "xoxo-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "sk-", "AIza", "npm_", "pypi-", "hf_", "SG.", "eyJ")
_FORMAT = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMATS.items()))
_BEFORE = re.compile(r"[A-Za-z0-9_]")

# Words that name a credential, alone or before "key", and words that turn the name into something else.
_NAMING = {"password", "passwd", "pass", "pwd", "pw", "passphrase", "passcode", "secret", "token", "tok", "apikey", "apisecret", "credential", "credentials", "bearer", "authtoken", "accesstoken", "secretkey", "accesskey", "pat"}
_BEFORE_KEY = {"api", "access", "secret", "private", "signing", "sign", "encryption", "encrypt", "auth", "account", "service", "master", "shared", "deploy", "client", "session"}
_OTHER = {"hash", "digest", "checksum", "sha", "sha1", "sha256", "name", "names", "file", "path", "url", "uri", "type", "kind", "count", "counts", "counter", "limit", "max", "min", "length", "len", "size", "ttl", "expiry", "expires", "index", "public", "pub", "fingerprint", "ref", "header", "field", "prefix", "suffix", "pattern", "policy", "manager", "tokenizer", "tokens", "usage", "budget", "version", "id", "arn", "scope", "label", "env", "var", "hint", "reset", "required", "valid", "status"}
_NAME_ANCHORS = ("pass", "pwd", "secret", "token", "tok", "key", "credential", "bearer", "pw")
_PHRASES = ("password", "passphrase", "passwort", "kennwort", "passcode", "mot de passe", "contraseña", "contrasena", "clave", "senha", "palavra-passe", "wachtwoord", "пароль", "ключ", "токен", "パスワード", "トークン", "鍵", "token", "key", "secret", "credential", "clé", "schlüssel", "sleutel", "chave", "log in", "login", "sign in", "anmelden")

_IDENTIFIER = re.compile(r"[\w.$-]*")
_VALUE = r"""(?:[bruf]{0,2}(?P<q>\\?["'`])(?P<quoted>[^\n"'`\\]*)(?P<end>\\?["'`]|\\|$|(?=\n))|(?P<bare>[^\s"'`,;&<>(){}\[\]\\|]+(?:\{[^\s"'`<>]*)?))"""
_ASSIGN = re.compile(r"""\\?["']?\]?(?P<sep>[^\S\n]*(?::=|=>|[:=])(?!=)[^\S\n]*|>|[^\S\n]+(?=\S+(?:[^\S\n]*(?:\\n|["'\\]|$)|\s*$|\n)))(?P<open>\((?:\s|\\n)*)?""" + _VALUE, re.M)
_MORE_PART = re.compile(r"""(?:\s|\\n|\+)*\\?["'](?P<part>[^\n"'`\\]+)\\?["']""")
_URL = re.compile(r"""(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?P<user>[^\s:/@"'<>\\]*):(?P<value>[^\s/@"'<>\\]+)@""")
_BEARER = re.compile(r"""(?:bearer|basic|token)[^\S\n]+(?P<value>[^\s"'`\\,;<>]+)""", re.I)
_USER_FLAG = re.compile(r"""-u[^\S\n]+\\?["']?(?P<user>[^\s:"'\\]+):(?P<value>[^\s"'\\]+)""")
_PASS_FLAG = re.compile(r"""(?m)(?:^|[\s"']|(?<=\\n))(?:mysql|mysqldump|mariadb|mongo|psql|sshpass|redis-cli|ldapsearch|mysqladmin)\b[^\n\\"]*?\s-(?:p|a|w)[^\S\n]?(?P<value>[^\s"'\\-][^\s"'\\]*)""")
_LONG_FLAG = re.compile(r"""--(?:password|passwd|token|api-key|secret|access-key|auth-token)(?:=|[^\S\n]+)\\?["']?(?P<value>[^\s"'\\]+)""", re.I)
_ARGUMENT = re.compile(r"""\((?:\s*\\?["'][^"'\n]*["']\s*,)?\s*\\?["'][\w.@-]{1,40}\\?["']\s*,\s*\\?["'](?P<value>[^\s"'\\]{6,})\\?["']""")
_PEM = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*?)PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----")
#: Lines of a key whose END line is missing: headers, full lines, and a last one that is shorter.
_PEM_BODY = re.compile(r"""(?:(?:\s|\\[nr]|["'+,])*(?:[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*:[^\n\\]*|[A-Za-z0-9+/=]{16,}))*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{1,15}={0,2}(?=[\n"'\\]|$))?""")
_TOLD = r"\s*[\"'`「]?(?P<value>[^\s\"'`「」,;<>()\[\]{}、。\\]+)"
#: After the phrase up to five words and a verb or colon; or the value at once.
_PROSE = re.compile(
    r"(?:s|es|n|word)?(?:[^\S\n]+(?!(?:is|ist|lautet|est|es|é|was|are)\b)[^\s.,;:!?=]+){0,5}?(?:[^\S\n]*[:=：]|[^\S\n]+(?:is|ist|lautet|est|es|é|was|again|with|mit|avec|con|com|met)\b:?|は|[^\S\n]+это|[^\S\n]+[-–—])" + _TOLD
)
_PROSE_AT_ONCE = re.compile(r"(?:s|es|n|word)?[^\S\n]+" + _TOLD)
_PLACEHOLDER = re.compile(
    r"(?i)(?:[*x•.#_-]+|0+|\.{3}|…|<.*|.*>|%.*%|\{\{.*|\$.*|.*\$\{.*|\[.*\]?|@.*|!.*ref.*|"
    r".*(?:your|my|the|enter|insert|add|put|replace|change)[-_ ]?(?:me|it|this|your|api|secret|token|password|key|here|own|with|pass|real).*|"
    r"todo|tbd|fixme|none|null|nil|undefined|true|false|yes|no|auto|redacted|masked|hidden|removed|example|sample|dummy|placeholder|changeme|secret|password|passwd|token|test|foo|bar|default|empty|string|str|int|bytes|bool|any|"
    r".*(?:redacted|masked|placeholder|changeme|example).*|"
    r"(?:vault|ssm|env|secretsmanager|keychain|op|aws|gcp|azure|sops|ref|file|kms)[:/(.].*|(?:process|os|env|config|settings|self|this|cfg|ctx|args|options|secrets|import|ENV)[.\[(:].*|.*(?:getenv|environ|get_secret|keyring|secretRef|valueFrom).*)"
)
_REFERENCE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+(?:\(.*)?|[A-Za-z_$][\w$]*\(.*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PATHLIKE = re.compile(r"(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]*\.\w{1,5}|[\w-]+\.(?:go|tsx?|jsx?|py|rs|sql|sh|md|ya?ml|json|toml|txt|html|css)(?::\d+)*:?")
_WORDY = re.compile(r"[A-Za-z_]+(?:[_-][A-Za-z]+)*|[a-z]+(?:[A-Z][a-z]+)+")
#: Forms that say themselves that they are a hash, a checksum or an identifier.
_HASHED = re.compile(
    r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|(?:sha-?[0-9](?:[-_/]?\d+)*|md5|crc32c?|blake[23][bs]?(?:-?\d+)?|xxh(?:ash)?\d*)[:=$-][\w+/=:$.-]+|"
    r"\$(?:1|2[abxy]?|5|6|7|y|gy|apr1|argon2(?:id?|d)|scrypt|pbkdf2[\w-]*|bcrypt-sha256)\$.*|(?:pbkdf2|bcrypt|argon2|scrypt|django|phpass)[\w:-]*\$.*|\{(?:S?SHA\d*|SSHA\d*|S?MD5|CRYPT|PBKDF2[\w-]*)\}.*"
)
#: A label of words, versions and years, and its parts that are no words.
_LABEL = re.compile(r"[a-z]+(?:[-_.](?:[a-z]+|v?\d{1,2}|(?:19|20)\d\d))+")
_LABEL_NUMBER = re.compile(r"[-_.](?:v?\d{1,2}|(?:19|20)\d\d)(?![^-_.])")

PLAIN_COST = 7.0
SHORTEST_WORD, LONGEST_WORD = 4, 14
#: Unexplained letters and digits of a credential: of a value with digits, of letters alone (and at least half of them), of an issuer's format.
LEAST_RESIDUAL, LEAST_LETTERS, LEAST_IN_FORMAT = 3, 6, 8
#: Symbols that no label or path has between its words, unexplained as letters are.
_HARD = set("!?+$@#%^&*~")
#: Words written as one that make a passphrase.
PASSPHRASE_WORDS = 4


@cache
def dictionary(path: str) -> dict[str, float]:
    """Words of the vocabulary in ``path`` and their cost: the logarithm of the rank, less for each letter they explain."""
    import json

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words: dict[str, float] = {}
    for token, rank in vocabulary.items():
        word = token.lstrip("Ġ").lower()
        if SHORTEST_WORD <= len(word) <= LONGEST_WORD and word.isascii() and word.isalpha():
            words[word] = min(words.get(word, 99.0), 4.0 + math.log(rank + 2.0))
    return words


def segment(value: str, words: dict[str, float]) -> tuple[int, int]:
    """The cheapest segmentation of ``value`` into words: how many letters, digits and hard symbols it leaves over, and how many words it has."""
    low = value.lower()
    n = len(low)
    best, left, used = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        c = low[i - 1]
        best[i], left[i], used[i] = best[i - 1] + (PLAIN_COST if c.isalnum() else 1.0), left[i - 1] + (c.isalnum() or c in _HARD), used[i - 1]
        if c.isalpha():
            for j in range(max(0, i - LONGEST_WORD), i - SHORTEST_WORD + 1):
                if (cost := words.get(low[j:i])) is not None and best[j] + cost < best[i]:
                    best[i], left[i], used[i] = best[j] + cost, left[j], used[j] + 1
    return left[n], used[n]


def unexplained(value: str, words: dict[str, float]) -> int:
    """Letters, digits and hard symbols of ``value`` that the cheapest segmentation into words leaves over."""
    return segment(value, words)[0]


def names_secret(name: str) -> bool:
    """Whether an identifier announces a credential."""
    parts = [p.lower() for p in _SPLIT_NAME.findall(name)]
    if not parts or any(p in _OTHER for p in parts):
        return False
    if any(p in _NAMING for p in parts):
        return True
    return any(p in ("key", "keys") and i and parts[i - 1] in _BEFORE_KEY for i, p in enumerate(parts)) or "keypem" in parts or ("key" in parts and "pem" in parts)


class Finder:
    """Finds the credentials of one text after the other."""

    def __init__(self, vocabulary: str):
        self.words = dictionary(vocabulary)
        automaton = ahocorasick.Automaton()
        groups: dict[str, set[str]] = {}
        for anchors, group in (
            (_FORMAT_PREFIXES, "format"),
            (_NAME_ANCHORS, "name"),
            (_PHRASES, "phrase"),
            (("-----begin",), "pem"),
            (("://",), "url"),
            (("bearer ", "basic "), "bearer"),
            ((" -u ",), "user"),
            ((" -p", " -a ", " -w "), "flag"),
            (("--pass", "--token", "--api-key", "--secret", "--access-key", "--auth-token"), "long"),
            (("connect(", "login(", "auth(", "authenticate(", "signin(", "sign_in(", "client(", "session("), "argument"),
        ):
            for a in anchors:
                groups.setdefault(a.lower(), set()).add(group)
        for a, g in groups.items():
            automaton.add_word(a, (len(a), tuple(sorted(g))))
        automaton.make_automaton()
        self.automaton = automaton

    def plausible(self, value: str, strict: bool, quoted: bool = False, password: bool = False) -> bool:
        """Whether a value may be a credential: what known formats and shapes do not exclude, the residual of its segmentation decides.

        ``strict``: it stands in prose or among arguments, where any word could; ``quoted``: it is a
        literal, so a dotted name with digits is no reference; ``password``: a password's name is before it.
        """
        if _HASHED.fullmatch(value):
            return False
        if _FORMAT.fullmatch(value):
            return unexplained(value, self.words) >= LEAST_IN_FORMAT
        if len(value) < 6 or _PLACEHOLDER.fullmatch(value) or _PATHLIKE.fullmatch(value):
            return False
        if _REFERENCE.fullmatch(value) and not (quoted and re.search(r"\d", value)):
            return False
        digits = sum(map(str.isdigit, value))
        letters = sum(map(str.isalpha, value))
        if letters == 0 and (digits == len(value) or strict or digits < 8):
            return False
        if not value.isascii() and strict:
            return False
        if strict:
            if len(value) < 8 or digits < 1 or letters < 4 or re.fullmatch(r"[A-Za-z]{0,3}[-#]?\d{1,8}|[vV]?\d+(?:\.\d+)+.*|\d{4}-\d\d.*|\d+[a-z]{1,2}", value) or "://" in value or value.endswith(("()", ")", ":")):
                return False
        # versions and years explain themselves in a label; under a password's name people do use them
        rest, used = segment(_LABEL_NUMBER.sub("", value) if not password and _LABEL.fullmatch(value) else value, self.words)
        if _WORDY.fullmatch(value):  # letters only, perhaps several words
            return rest >= max(LEAST_LETTERS, len(value) // 2) or password and used >= PASSPHRASE_WORDS and rest < LEAST_RESIDUAL and value.isalpha() and value.islower()
        return rest >= LEAST_RESIDUAL

    def _assigned(self, text: str, at: int, size: int) -> list[tuple[int, int, str]]:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_-.$"):
            start -= 1
        while start < at and text[start] in "-.$":
            start += 1
        stop = _IDENTIFIER.match(text, at + size).end()
        # a newline escaped in the text is no part of the name
        name = text[start:stop]
        if start and text[start - 1] == "\\" and name[:1] in "ntr":
            name = name[1:]
        name = name.rstrip("-.")
        if not names_secret(name):
            return []
        m = _ASSIGN.match(text, stop)
        if not m:
            return []
        value = m["quoted"] if m["quoted"] is not None else m["bare"]
        begin = m.start("quoted") if m["quoted"] is not None else m.start("bare")
        if not value:
            return []
        separator = m["sep"]
        spaced = not separator.strip()
        if spaced:
            before = text[text.rfind("\n", 0, start) + 1 : start]
            before = before[before.rfind("\\n") + 2 :] if "\\n" in before else before
            bare_line = not before.strip(" \t+-\"'")
            if not (bare_line and m["quoted"] is None and name.lower() in ("password", "passwd", "passphrase", "secret") or re.search(r"\b(?:ENV|ARG|export|set|setenv|machine\s.*|login\s+\S+)\s+$", before)):
                return []
        if separator == ">":
            if text[start - 1 : start] != "<":
                return []
            value = value.split("<")[0]
        if m["quoted"] is None:
            value = value.rstrip(",;")
            if separator.strip() in (":", "") and value in ("|", ">", "-"):
                return []
        parts = [(begin, begin + len(value))]
        if m["quoted"] is not None and (m["open"] or re.match(r"\s*\+|\s*\\\n", text[m.end() : m.end() + 4])):
            end, joined = m.end(), value
            while more := _MORE_PART.match(text, end):
                joined += more["part"]
                parts.append((more.start("part"), more.end("part")))
                end = more.end()
            value = joined
        if _PEM.match(value) or "PRIVATE KEY" in value:
            return []  # the key block has an anchor of its own
        bearer = re.match(r"(?i)(?:bearer|basic|token)\s+(\S+)$", value)
        if bearer:
            parts = [(begin + bearer.start(1), begin + len(value))]
            value = bearer[1]
        if " " in value.strip() and m["quoted"] is not None and not re.fullmatch(r"\S+(?: \S+){3,}", value) is None:
            return []
        unquoted_code = m["quoted"] is None and separator.strip() in ("=", ":", ":=") and re.fullmatch(r"[A-Za-z_]\w*", value) and not re.search(r"\d", value)
        if unquoted_code and _WORDY.fullmatch(value) and unexplained(value, self.words) < 10:
            return []
        password = re.search(r"(?i)pass|pwd|pw$", name) is not None
        return [(a, b, "assigned") for a, b in parts] if self.plausible(value, False, m["quoted"] is not None, password) else []

    def _key_block(self, text: str, m: re.Match) -> tuple[int, int] | None:
        """The private key block that ``m`` begins: up to its END line, or, where that is missing, to the end of what can be its lines."""
        other = _PEM.search(text, m.end())
        end = _PEM_END.search(text, m.end(), other.start() if other else len(text))
        stop = end.start() if end else _PEM_BODY.match(text, m.end()).end()
        body = text[m.end() : stop]
        if len(re.findall(r"[A-Za-z0-9+/=]", body.replace("\\n", "").replace("\\r", ""))) < 16 or re.search(r"(?i)redacted|\*\*\*|<[a-z]|xxxx", body):
            return None
        return m.start(), end.end() if end else stop

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and kind of each credential of ``text``, in order, overlaps merged; parts of one count each."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int, str]] = []
        lines: set[tuple[str, int]] = set()
        closed = 0
        for last, (size, groups) in self.automaton.iter(low):
            at = last - size + 1
            for group in groups:
                if group == "format":
                    if (m := _FORMAT.match(text, at)) and not (at and _BEFORE.match(text[at - 1])) or (m and at >= 2 and text[at - 2] == "\\"):
                        if unexplained(m[0], self.words) >= LEAST_IN_FORMAT:
                            found.append((m.start(), m.end(), m.lastgroup))
                elif group == "name":
                    found += self._assigned(text, at, size)
                elif group == "pem":
                    if at >= closed and (m := _PEM.match(text, at)) and (block := self._key_block(text, m)):
                        found.append((*block, "private_key"))
                        closed = block[1]
                elif group == "bearer":
                    m = _BEARER.match(text, at)
                    if m and self.plausible(m["value"].rstrip(".,;:"), True):
                        found.append((m.start("value"), m.start("value") + len(m["value"].rstrip(".,;:")), "authorization"))
                elif group == "phrase":
                    if at and (text[at - 1].isalnum() or text[at - 1] in "_-/.$") and low[at].isascii():
                        continue
                    for m in filter(None, (_PROSE.match(text, at + size), _PROSE_AT_ONCE.match(text, at + size))):
                        value = m["value"].rstrip(".,;:。、")
                        value = value[:-1] if value.endswith("!") and not re.search(r"[^\w!]", value[:-1]) and not re.search(r"\d!$", value) else value
                        if self.plausible(value, True) and "=" not in value[:-2] and not re.fullmatch(r"[0-9a-f]{7,12}", value):
                            found.append((m.start("value"), m.start("value") + len(value), "told"))
                else:
                    line = (group, text.rfind("\n", 0, at) + 1)
                    if line in lines:
                        continue
                    lines.add(line)
                    stop = text.find("\n", at)
                    stop = len(text) if stop < 0 else stop
                    pattern, kind, strict = {"url": (_URL, "url", False), "user": (_USER_FLAG, "command", False), "flag": (_PASS_FLAG, "command", False), "long": (_LONG_FLAG, "command", False), "argument": (_ARGUMENT, "argument", True)}[group]
                    for m in pattern.finditer(text, line[1], stop):
                        value = m["value"]
                        if self.plausible(value, strict):
                            found.append((m.start("value"), m.end("value"), kind))
        if not found:
            return []
        found.sort(key=lambda x: (x[0], -x[1]))
        merged = [found[0]]
        for a, b, kind in found[1:]:
            if a < merged[-1][1]:
                if b > merged[-1][1]:
                    merged[-1] = (merged[-1][0], b, merged[-1][2])
            else:
                merged.append((a, b, kind))
        return merged


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by ``[REDACTED:kind]``; everything else stays, quotes included."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[REDACTED:{kind}]"]
        last = b
    return "".join([*out, text[last:]])


def first_lines(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    """The line, from 1, on which each span begins."""
    lines, line, last = [], 1, 0
    for a, _, _ in spans:
        line += text.count("\n", last, a)
        last = a
        lines.append(line)
    return lines


def find_secrets(df: DataFrame, key: str, fields: list[str], vocabulary: str) -> DataFrame:
    """``record_id, field, line_no, kind``: a row for each line of a field on which a credential begins.

    The parts of a split credential count at the first part. Null and empty texts give no row, repeated
    rows the same rows again (callers that count records take distinct ones), a null key a null record
    id; other columns are ignored. ``vocabulary`` is the JSON file of a public tokenizer.
    """

    def make():
        finder = Finder(vocabulary)

        def look(rows: dict) -> dict:
            out: dict[str, list] = {"record_id": [], "field": [], "line_no": [], "kind": []}
            for name in fields:
                for k, text in zip(rows["_key"], rows[name]):
                    spans = finder.find(text)
                    seen = set()
                    for line, (_, _, kind) in zip(first_lines(text, spans) if spans else [], joined_parts(text, spans)):
                        if kind and line not in seen:
                            seen.add(line)
                            out["record_id"].append(k)
                            out["field"].append(name)
                            out["line_no"].append(line)
                            out["kind"].append(kind)
            return out

        return look

    source = df.select(F.col(key).cast("string").alias("_key"), *fields)
    return map_lists(source, make, "record_id string, field string, line_no bigint, kind string")


_BETWEEN_PARTS = re.compile(r"""\\?["'](?:\s|\\n|\+)*\\?["']""")


def joined_parts(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans with the kind of each later part of a split credential blanked."""
    out, last = [], None
    for a, b, kind in spans:
        follows = last is not None and a - last < 200 and _BETWEEN_PARTS.fullmatch(text, last, a)
        out.append((a, b, "" if follows else kind))
        last = b
    return out


def redact_secrets(df: DataFrame, key: str, fields: list[str], vocabulary: str) -> DataFrame:
    """``key`` and ``fields`` of each row, every credential replaced by ``[REDACTED:kind]``; nulls stay null."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        finder = Finder(vocabulary)
        return lambda rows: {key: rows[key]} | {f: [t and redact(t, finder.find(t)) for t in rows[f]] for f in fields}

    return map_lists(df.select(key, *fields), make, f"`{key}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))
