"""Personal information in free text, by anchor expansion.

An Aho-Corasick automaton over the whole text finds anchors: at-signs and their spelt forms, cues of
identity and telephone numbers, street words, post boxes, titles, given names and the phrases that
introduce a name. Around each anchor a deterministic parser expands to the boundaries of the address,
number or name and validates it; it looks at words, so no length of theirs hides one. Telephone numbers
and the national numbers of a fixed form need no cue: runs of digits are anchors of their own.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists

TYPES = ("email", "phone", "id_number", "address", "name")

# Cue words by type, as people write them in the eight languages of the corpus.
_ID_CUES = ("ssn", "social security", "passport", "reisepass", "pasaporte", "passeport", "passaporte", "paspoort", "паспорт", "national id", "national insurance", "nino", "nin ", "dni", "nie ", "nif", "cpf", "bsn", "снилс", "инн", "tax id", "tax number", "tin ", "steuer-id", "steuernummer", "steueridentifikationsnummer", "personalausweis", "ausweisnummer", "identity number", "identity card", "id number", "id card", "numéro fiscal", "numéro de sécurité sociale", "sécurité sociale", "número de identificación", "seguridad social", "identificatienummer", "マイナンバー", "旅券番号")
_PHONE_CUES = ("phone", "tel", "tél", "call", "llama", "number is", "numéro", "unter", "erreich", "mobile", "cell", "handy", "móvil", "fax", "ext.", "whatsapp", "sms", "appel", "anruf", "rufnummer", "телефон", "電話", "ring ", "dial", "bel ", "ligue", "contact")
_STREET_BEFORE = ("rue", "avenue", "boulevard", "chemin", "allée", "impasse", "quai", "place", "route", "cours", "calle", "avenida", "avda.", "plaza", "paseo", "camino", "carrera", "rua", "travessa", "largo", "praça", "via", "viale", "piazza", "ул.", "улица", "проспект", "пр.", "пер.")
_STREET_AFTER = ("road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "drive", "dr", "boulevard", "blvd", "court", "ct", "close", "crescent", "terrace", "place", "pl", "square", "sq", "way", "row", "hill", "grove", "gardens", "park", "parkway", "pkwy", "highway", "hwy", "quay", "mews", "walk", "rise", "view", "circle", "loop", "trail")
_STREET_END = ("weg", "straße", "strasse", "str.", "allee", "platz", "gasse", "ring", "damm", "ufer", "chaussee", "steig", "pfad", "straat", "laan", "plein", "gracht", "kade", "dijk", "singel")
_BOXES = ("p.o. box", "po box", "p. o. box", "post box", "postfach", "apartado", "boîte postale", "caixa postal", "postbus", "casilla", "а/я", "私書箱")
_TITLES = ("mr", "mrs", "ms", "mx", "miss", "dr", "prof", "sir", "herr", "frau", "mme", "mlle", "madame", "monsieur", "señor", "señora", "sr", "sra", "dona", "senhor", "senhora", "dhr", "mevr", "mevrouw", "meneer")
#: Phrases after which (or before which) a name stands, also in small letters.
_NAME_AFTER = ("reported by ", "written by ", "reviewed by ", "approved by ", "assigned to ", "signed-off-by", "co-authored-by", "reviewed-by", "acked-by", "reported-by", "author:", "author=", "committer:", "reporter=", "reporter:", "owner=", "assignee=", "assignee:", "my name is ", "i am called ", "mein name ist ", "je m'appelle ", "me llamo ", "mi nombre es ", "meu nome é ", "mijn naam is ", "меня зовут ", "attention ", "attn", "z. hd.", "zu händen", "à l'attention de ", "cc ", "ask ", "contact ", "dear ", "bitte an ", "rechnung an ", "signed ", "from: ", "to: ", "name: ", "name=", '"name": "', "customer ", "client ", "patient ")
_NAME_BEFORE = (" asked for this", " reported this", " called about", " wrote to us", " signed off", " and i own this", " hat angerufen", " a appelé", " llamó")
_SIGN_OFF = ("thanks", "thank you", "regards", "best", "cheers", "grüße", "gruß", "cordialement", "saludos", "gracias", "merci", "danke", "atenciosamente", "obrigado", "obrigada", "groeten", "bedankt", "с уважением", "спасибо", "sincerely", "yours")
#: Given names of the eight languages' countries and their neighbours; with a surname after one a name needs no phrase.
_GIVEN = ("adam", "aisha", "alejandro", "alexander", "alice", "amina", "amy", "ana", "andrea", "andreas", "andrew", "anna", "anna-lena", "anne", "antoine", "antonio", "beatriz", "ben", "bruno", "camille", "carla", "carlos", "caroline", "catarina", "charlotte", "chloe", "christian", "christine", "claire", "claudia", "daan", "daniel", "david", "diego", "dmitri", "eduardo", "elena", "eleanor", "elizabeth", "emily", "emma", "eva", "fatima", "felix", "fernando", "florian", "francisco", "frank", "gabriel", "george", "giulia", "guilherme", "hannah", "hans", "helen", "henry", "hiroshi", "hugo", "ines", "isabel", "ivan", "jack", "james", "jan", "jane", "javier", "jean", "jennifer", "joana", "johanna", "johannes", "john", "jonas", "jonathan", "jorge", "jose", "josé", "juan", "julia", "julien", "jürgen", "kate", "katharina", "kenji", "klaus", "laura", "lea", "lena", "leon", "linda", "lisa", "louis", "lucas", "lucia", "lucía", "luis", "lukas", "manuel", "marc", "marco", "maria", "maría", "marie", "mario", "mark", "markus", "martin", "mary", "mathilde", "matthias", "maximilian", "mehmet", "michael", "miguel", "mohammed", "nadia", "natalia", "nicolas", "nina", "nora", "oliver", "olivia", "olga", "omar", "pablo", "patricia", "paul", "paula", "pedro", "peter", "philipp", "pierre", "priya", "rachel", "rafael", "ravi", "raquel", "ricardo", "robert", "roberto", "rosa", "sabine", "samuel", "sara", "sarah", "sebastian", "sergei", "sofia", "sophie", "stefan", "stephen", "susan", "sven", "svetlana", "tatiana", "teresa", "thomas", "tiago", "tim", "tobias", "tom", "ursula", "victor", "wei", "william", "wolfgang", "yuki", "yusuf")
#: What follows a name in a script without case, and the words it also follows.
_HONORIFICS = ("さん", "様", "氏")
_NO_HONORIFIC = ("皆", "皆様", "お客", "客", "仕", "同", "多", "模", "異", "有", "各", "両", "奥", "神", "王", "ユーザー", "オーナー", "メンバー", "リーダー", "マネージャー", "エンジニア", "スタッフ", "チーム", "利用者", "担当者", "管理者", "開発者")
_NO_NAME = {"the", "a", "an", "this", "that", "it", "we", "you", "they", "me", "him", "her", "us", "them", "everyone", "someone", "anyone", "nobody", "who", "what", "whoever", "team", "user", "users", "bot", "build", "merge", "queue", "service", "server", "admin", "root", "system", "agent", "assistant", "reviewer", "owner", "maintainer", "maintainers", "support", "null", "none", "true", "false", "before", "after", "for", "to", "in", "on", "at", "by", "with", "from", "of", "about", "how", "why", "when", "where", "if", "and", "or", "not", "my", "your", "our", "his", "their", "all", "any", "each", "last", "next", "new", "old", "first", "only", "just", "still", "here", "there", "please", "again", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las", "il", "de", "is", "are", "was", "be", "has", "have", "row", "rows", "file", "files", "test", "tests", "code", "data", "line", "lines", "index", "node", "nodes", "email", "phone", "address", "ticket", "order", "token", "key", "id", "dev", "box", "api", "db", "error", "warn", "info", "debug", "update", "add", "begin", "end", "patch", "select", "insert", "into", "values", "open", "active", "closed"}

#: Words that after a given name make it a place, a product or a plan.
_COMMON_AFTER = {"street", "road", "avenue", "lane", "hall", "room", "school", "university", "hospital", "project", "server", "service", "cluster", "node", "build", "release", "branch", "team", "meeting", "test", "pipeline", "model", "index", "queue", "session", "store", "database", "table", "code"}

_CASELESS = re.compile(r"(?:[\u4e00-\u9fff々]{2,6}|[\u30a0-\u30ff]{2,10}(?:[・ ][\u30a0-\u30ff]{2,10})?)[\s\u3000]?$")
_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}(?:{_LETTER}|(?<={_LETTER})['’-](?={_LETTER}))*"
_TITLE = rf"(?:{'|'.join(_TITLES)})"
_TITLE_AT = re.compile(rf"(?i)(?<!\w){_TITLE}\.?[^\S\n]+")
_NAME = re.compile(rf"(?:(?i:(?P<title>{_TITLE}))(?:\.[^\S\n]*|[^\S\n]+))?(?P<words>{_WORD}(?:(?:,[^\S\n]|[^\S\n])(?:{_LETTER}\.|{_WORD}))*)")
_DOMAIN = re.compile(r"(?:[\w](?:[\w-]*[\w])?\.)+[^\W\d_]{2,24}(?![\w-])", re.I)
_SPELT_DOMAIN = re.compile(r"[^\S\n]*(?P<first>[\w-]+)(?P<rest>(?:(?:[^\S\n]*[\[({][^\S\n]*(?:dot|punkt|point|punto|ponto|punt|точка)[^\S\n]*[\])}][^\S\n]*|[^\S\n]+(?:dot|punkt|point|punto|ponto|punt|точка)[^\S\n]+|\.)[\w-]+)+)", re.I)
_SPELT_AT = ("(at)", "[at]", "{at}", " at ", "(arroba)", "[arroba]", " arroba ", "(@)", "[@]", "(a)", "&#64;", "%40")
_ID_VALUE = re.compile(r"(?:[^\S\n]*(?:no|nr|number|num|nummer|número|numéro|card|code|is|ist|est|es|lautet)\b\.?|[^\S\n]*[:=#№]|[^\S\n])*[\"'(]*(?P<value>(?-i:[A-Z]{0,3}[- ]?\d(?:[ ]?[-./]?(?:\d|[A-Z](?![a-z])))*))(?![\w])", re.I)
_ID_FORMS = re.compile(r"(?<![\w.#/-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}\.\d{3}\.\d{3}-\d{2}|[XYZ]?\d{7,8}-[A-Z])(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w.,/#@+=$%&*~^-])(?<!\d[ (:])(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}"
    r"|\(0\d{1,5}\)[ ./-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|0\d{1,4}/\d{3,}(?:[ -]?\d{2,})*"
    r"|0\d(?:[. ]\d\d){4}"
    r"|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}"
    r"|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}"
    r"|\d{3}-\d{4}"
    r")(?:[^\S\n]?(?:ext\.?|x|extension|durchwahl|poste)[^\S\n]?\d{1,6})?(?![\w@]|[.,:/-]\d|-\w)",
    re.I,
)
_NOT_PHONE = re.compile(r"(?:order|ticket|trace|build|version|issue|case|invoice|tracking|ref(?:erence)?|commit|row|line|epoch|port|error|code|id|ssn|passport|dni|no|nr|security|pr|bug|span|request|session|job)[^\S\n]*(?:no\.?|nr\.?|number|id)?[^\S\n]*[:=#]?[^\S\n]*$", re.I)
_UNIT = r"(?:,?[^\S\n]+(?:apt|apartment|unit|suite|ste|flat|floor|#|no)\.?[^\S\n]*\w{1,6}|,[^\S\n]*\d{1,3}[ºª°][^\S\n]?\w{0,3})?"
_TOWN = rf"(?:[^\S\n]*,[^\S\n]*|[^\S\n]+(?=\d{{4,6}}[^\S\n]))(?:(?:[A-Z]{{1,2}}-)?\d{{4,6}}[^\S\n]+)?(?P<town>[A-ZÀ-ÞА-Я](?:[^\W\d_]|['’-])+(?!\w)(?:[^\S\n](?:[A-ZÀ-ÞА-Я](?:[^\W\d_]|['’-])+(?!\w)|de|la|del|am|an|der|sur|les|le|upon|of|do|da))*)(?:,?[^\S\n]+(?:(?:[A-Z]{{2}}[^\S\n]+)?\d{{4,6}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?[^\S\n]?\d[A-Z]{{2}}|[A-Z]\d[A-Z][^\S\n]?\d[A-Z]\d)(?![\w]))?"
_AFTER_NUMBER = re.compile(rf"(?<![\w.])\d{{1,5}}[a-zA-Z]?,?[^\S\n]+(?:[NSEW]\.?[^\S\n]+)?(?:[A-ZÀ-Þ][\w'’-]+[^\S\n]+){{1,4}}(?i:{'|'.join(_STREET_AFTER)})\b\.?{_UNIT}{_TOWN}")
_BEFORE_NUMBER = re.compile(rf"(?i:{'|'.join(map(re.escape, _STREET_BEFORE))})[^\S\n]+(?:[\w'’.-]+[^\S\n]+){{0,6}}?[\w'’-]+,?[^\S\n]+(?:n[º°o]\.?[^\S\n]*)?\d{{1,5}}[a-zA-Z]?{_UNIT}{_TOWN}")
_NUMBER_FIRST = re.compile(rf"(?<![\w.])\d{{1,5}}(?:[^\S\n]?(?:bis|ter))?,?[^\S\n]+(?i:{'|'.join(map(re.escape, _STREET_BEFORE))})[^\S\n]+(?:[\w'’.-]+[^\S\n]+){{0,6}}?[\w'’-]+{_UNIT}{_TOWN}")
_JOINED = re.compile(rf"(?<!\w)(?:[A-ZÀ-Þ][\w'’-]*[^\S\n-])?[A-ZÀ-Þ][\w'’-]*(?:{'|'.join(map(re.escape, _STREET_END))})[^\S\n]+\d{{1,5}}[^\S\n]?[a-zA-Z]?(?!\w){_UNIT}{_TOWN}")
_BOX = re.compile(rf"(?i:{'|'.join(re.escape(b).replace(chr(92) + ' ', ' ?') for b in _BOXES)})[^\S\n]*(?:no\.?[^\S\n]*|nr\.?[^\S\n]*)?\d[\d ]{{0,7}}{_TOWN}")
_VALUES = re.compile(r"""VALUES[^\S\n]*\([^'\n]{0,40}'(?P<name>(?:[^'\n]|'')*)'""", re.I)
_CELL = re.compile(r"(?m)^[^\S\n]*\|?[^\S\n]*\d+[^\S\n]*\|[^\S\n]*(?P<name>[^|\n]+?)[^\S\n]*\|[^\S\n]*(?P<next>[^|\n]+)")
_CSV = re.compile(r"(?m)^(?:\d+,)(?P<name>[^\n@]+?),(?P<next>[^,\n]*(?:@|[(\[]at[)\]])[^,\n]*)")
_VCARD = re.compile(r"(?m)^(?:FN|N)(?:;[^:\n]*)?:(?P<name>[^\n]+)$")


def _back(text: str, at: int, words: int) -> int:
    """The start of the ``words`` runs without white space before ``at``, not beyond the line's start."""
    while at and words:
        at -= 1
        while at and text[at] in " \t\u00a0" and text[at - 1] != "\n":
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
        words -= 1
        if at and text[at - 1] in "\r\n":
            break
    return at


_RUN = re.compile(r"\s*\S+")


def _ahead(text: str, at: int, words: int) -> int:
    """The end of the ``words`` runs without white space from ``at``."""
    while words and (m := _RUN.match(text, at)):
        at = m.end()
        words -= 1
    return at if not words else len(text)


class Finder:
    """Finds the personal information of one text after the other."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        groups: dict[str, set[str]] = {}
        for anchors, group in (
            (("@",), "at"),
            (_SPELT_AT, "spelt"),
            (_ID_CUES, "id"),
            (tuple(f" {w}" for w in _STREET_AFTER), "street_after"),
            (tuple(f"{w} " for w in _STREET_BEFORE), "street_before"),
            (_STREET_END, "street_end"),
            (_BOXES, "box"),
            (tuple(f"{t}. " for t in _TITLES) + tuple(f"{t} " for t in _TITLES), "title"),
            (_NAME_AFTER, "name_after"),
            (_NAME_BEFORE, "name_before"),
            (_SIGN_OFF, "sign_off"),
            (("values",), "values"),
            (tuple(f"{g} " for g in _GIVEN), "given"),
            (_HONORIFICS, "honorific"),
        ):
            for a in anchors:
                groups.setdefault(a, set()).add(group)
        for a, g in groups.items():
            self.automaton.add_word(a, (len(a), tuple(sorted(g))))
        self.automaton.make_automaton()

    @staticmethod
    def _email(text: str, at: int) -> tuple[int, int] | None:
        right = _DOMAIN.match(text, at + 1)
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%'-"):
            start -= 1
        if start == at or not right:
            return None
        while start < at and text[start] in ".'%+-":
            start += 1
        if start == at:
            return None
        if start >= 2 and text[start - 1] == "\\" and text[start] in "ntr" and start + 1 < at:
            start += 1  # an escaped line break before the address
        before = text[max(0, start - 8) : start]
        if before.endswith(("/", "@", ":")) and not before.lower().endswith(("mailto:", "to:", "from:", "cc:", "mail:", "email:", "e-mail:")) and (before.endswith(("/", "@")) or re.search(r"://[^\s\"'<>]*$", text[max(0, start - 120) : start])):
            return None  # a user in a URL, a package scope
        after = text[right.end() : right.end() + 2]
        if after[:1] == ":" and after[1:] and (after[1:].isalnum() or after[1:] in "/~"):
            return None  # a remote: user@host:path
        if after[:1] == "/" and text[start:at].lower() in ("git", "svn", "hg", "ssh", "root"):
            return None
        return start, right.end()

    @staticmethod
    def _spelt(text: str, at: int, size: int) -> tuple[int, int] | None:
        stop = at
        while stop and text[stop - 1] in " \t":
            stop -= 1
        start = stop
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        right = _SPELT_DOMAIN.match(text, at + size)
        if start == stop or not right:
            return None
        bracketed = text[at : at + size].strip() != text[at : at + size] or text[at] not in "([{&%"
        dots = re.findall(r"(?i)[\[({][^\S\n]*(?:dot|punkt|point|punto|ponto|punt|точка)[^\S\n]*[\])}]|[^\S\n](?:dot|punkt|point|punto|ponto|punt|точка)[^\S\n]", right["rest"])
        if bracketed and not dots:
            return None  # "at" as a word needs a spelt dot too
        last = re.split(r"[^\w-]+", right["rest"].strip())[-1]
        if not re.fullmatch(r"[^\W\d_]{2,24}", last):
            return None
        return start, right.end()

    @staticmethod
    def _full_name(text: str, start: int, stop: int | None = None, lower: bool = True) -> tuple[int, int] | None:
        """The name at ``start``: a title with a surname, or at least two words of a full name."""
        m = _NAME.match(text, start, stop if stop is not None else _ahead(text, start, 8))
        if not m:
            return None
        pieces = [(p.start() + m.start("words"), p[0]) for p in re.finditer(rf"{_LETTER}\.(?=[^\S\n])|{_WORD}|,", m["words"])]
        style, taken, comma = "", [], False
        for at, piece in pieces:
            if piece == ",":
                if comma or len(taken) != 1:
                    break
                comma = True
                continue
            if piece.lower() in _NO_NAME or len(taken) >= 4:
                break
            initial = len(piece) == 2 and piece[1] == "."
            mine = "" if initial else "upper" if piece.isupper() and len(piece) > 1 else "title" if piece[0].isupper() else "lower"
            if not initial and style and mine != style:
                break
            style = style or mine
            taken.append((at, piece))
        while taken and len(taken[-1][1]) == 2 and taken[-1][1].endswith("."):
            taken.pop()
        full = [p for _, p in taken if not p.endswith(".") and len(p) > 1]
        if comma and len(taken) == 1:
            comma = False
        if not full or style == "lower" and not lower or any(not any(c.islower() or c.isupper() for c in p) for p in full):
            return None
        if m["title"] is None and len(taken) < 2 or m["title"] is not None and style == "lower":
            return None
        if style == "lower" and len(taken) > 3:
            return None
        return m.start(), taken[-1][0] + len(taken[-1][1])

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and type of each piece of personal information of ``text``, in order, without overlaps."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[tuple[int, int, str]] = []
        add = found.append
        signed = False
        for last, (size, groups) in self.automaton.iter(low):
            at = last - size + 1
            for group in groups:
                if group == "at":
                    if span := self._email(text, at):
                        add((*span, "email"))
                        self._beside_email(text, span, add)
                elif group == "spelt":
                    if span := self._spelt(text, at, size):
                        add((*span, "email"))
                elif group == "id":
                    if at and text[at - 1].isalnum():
                        continue
                    if (m := _ID_VALUE.match(text, last + 1)) and 6 <= sum(map(str.isdigit, m["value"])) <= 14:
                        add((m.start("value"), m.end("value"), "id_number"))
                elif group == "street_after":
                    if (text[last + 1 : last + 2].isalnum()) or not text[at - 1 : at].strip():
                        continue
                    for m in _AFTER_NUMBER.finditer(text, _back(text, at, 6), _ahead(text, last, 14)):
                        if m.start() <= at < m.end():
                            add((*m.span(), "address"))
                elif group == "street_before":
                    if at and text[at - 1].isalpha():
                        continue
                    m = _BEFORE_NUMBER.match(text, at)
                    if m:
                        add((*m.span(), "address"))
                    for m in _NUMBER_FIRST.finditer(text, _back(text, at, 2), _ahead(text, at, 20)):
                        if m.start() < at < m.end():
                            add((*m.span(), "address"))
                elif group == "street_end":
                    if not text[last + 1 : last + 2].isspace() or not re.match(r"[^\S\n]+\d", text[last + 1 : last + 8]):
                        continue
                    for m in _JOINED.finditer(text, _back(text, at, 2), _ahead(text, last, 14)):
                        if m.start() <= at < m.end():
                            add((*m.span(), "address"))
                elif group == "box":
                    if m := _BOX.match(text, at):
                        add((*m.span(), "address"))
                elif group == "title":
                    if at and (text[at - 1].isalnum() or text[at - 1] in "-_./'"):
                        continue
                    if text[at].isupper() and (span := self._full_name(text, at, lower=False)) and span[0] == at and span[1] > last + 1:
                        add((*span, "name"))
                elif group == "name_after":
                    if at and (text[at - 1].isalnum() or text[at - 1] in "-_"):
                        continue
                    start = last + 1
                    while start < len(text) and text[start] in " \t:=\"'":
                        start += 1
                    weak = low[at : last + 1] in ("cc ", "ask ", "contact ", "dear ", "signed ", "customer ", "client ", "patient ", "applicant ", "attention ", "name: ", "name=", '"name": "', "from: ", "to: ")
                    if span := self._full_name(text, start):
                        if text[start].islower() and (weak and not self._closed(text, span[1])):
                            continue
                        if weak and not self._closed(text, span[1]) and low[at : last + 1] in ("ask ", "contact ", "dear ", "customer ", "client ", "name=", "to: ", "from: "):
                            continue
                        add((*span, "name"))
                elif group == "name_before":
                    line = _back(text, at, 6)
                    head = text[line:at]
                    tail = rf"(?:(?:{_TITLE}\.?[^\S\n]+)?{_WORD}(?:(?:,[^\S\n]|[^\S\n])(?:{_LETTER}\.|{_WORD})){{0,3}})$"
                    if m := re.search(tail, head, re.I):
                        words = m[0]
                        for k in range(len(words)):
                            if (k == 0 or words[k - 1] in " ") and (span := self._full_name(text, line + m.start() + k, at)) and span[1] == at:
                                add((*span, "name"))
                                break
                elif group == "given":
                    if (at and (text[at - 1].isalnum() or text[at - 1] in "-_./'@\\")) or not text[at].isupper():
                        continue
                    if (span := self._full_name(text, at, lower=False)) and span[1] > last + 1 and self._alone(text, span):
                        add((*span, "name"))
                elif group == "honorific":
                    if (m := _CASELESS.search(text, max(0, at - 24), at)) and m[0] not in _NO_HONORIFIC and not m[0].endswith(_NO_HONORIFIC):
                        add((m.start(), last + 1, "name"))
                elif group == "sign_off":
                    signed = True
                elif group == "values":
                    if (m := _VALUES.match(text, at)) and (span := self._full_name(text, m.start("name"), m.end("name"))) and span[1] == m.end("name"):
                        add((*span, "name"))
        if signed:
            self._signatures(text, add)
        for m in _ID_FORMS.finditer(text):
            if not re.search(r"(?i)(?:order|ticket|trace|build|uuid)\W*(?:no\.?|id|#)?\W*$", text[max(0, m.start() - 16) : m.start()]):
                add((*m.span(), "id_number"))
        for m in _PHONE.finditer(text):
            self._phone(text, low, m, add)
        if "|" in text:
            for m in _CELL.finditer(text):
                if re.search(r"\d[\d ()./+-]{5,}\d|@", m["next"]) and (span := self._full_name(text, m.start("name"), m.end("name"))) and span[1] == m.end("name"):
                    add((*span, "name"))
        if any(kind == "email" for *_, kind in found):
            for m in _CSV.finditer(text):
                if (span := self._full_name(text, m.start("name"), m.end("name"))) and span[1] == m.end("name"):
                    add((*span, "name"))
        if "FN" in text:
            for m in _VCARD.finditer(text):
                if (span := self._full_name(text, m.start("name"), m.end("name"))) and span[1] == m.end("name"):
                    add((*span, "name"))
        return _without_overlaps(found)

    @staticmethod
    def _closed(text: str, end: int) -> bool:
        """Whether something that ends a name follows: the line, punctuation, an address, or a small word of the phrase."""
        return bool(re.match(r"[^\S\n]*(?:$|\n|\\n|[.,;:<>()\[\]|\"'!?]|(?:before|after|about|for|if|when|or|and|last|asked|said|please|avant|bevor|antes|oder|ou|o|y|und|et|e)\b)", text[end : end + 20]))

    @staticmethod
    def _alone(text: str, span: tuple[int, int]) -> bool:
        """Whether a given name with a surname stands as a person's: no part of a longer title, path or identifier, its surname no common word."""
        words = text[span[0] : span[1]].split()
        after = text[span[1] : span[1] + 1]
        if len(words) < 2 or words[0].isupper() and len(words[0]) > 1 or after in ("_", "/", "\\", "@", "(", "=") or words[-1].lower().rstrip("s") in _COMMON_AFTER:
            return False
        return not re.match(r"[^\S\n](?:[A-Z][\w-]*[^\S\n]){2}", text[span[1] : span[1] + 40])

    def _beside_email(self, text: str, span: tuple[int, int], add) -> None:
        """The name before ``<address>``, when it stands alone between the line's start or a cue and the bracket."""
        if text[span[0] - 1 : span[0]] != "<":
            return
        line = _back(text, span[0], 7)
        head = text[line : span[0] - 1].rstrip()
        m = re.search(rf"(?:^|[:;,=>]|\bcc|\bby|\bto|\bfrom|\bfor|\\n)[^\S\n]*(?P<name>(?:{_TITLE}\.?[^\S\n]+)?{_WORD}(?:(?:,[^\S\n]|[^\S\n])(?:{_LETTER}\.|{_WORD})){{0,3}})$", head, re.I)
        if m and (name := self._full_name(text, line + m.start("name"), line + m.end("name"))) and name[1] == line + m.end("name"):
            add((*name, "name"))

    def _signatures(self, text: str, add) -> None:
        """The name alone on the line after a closing phrase."""
        for m in re.finditer(rf"(?im)(?:{'|'.join(_SIGN_OFF)})[^\n.?]{{0,24}}[,!.]?[^\S\n]*(?:\r?\n|\r|\\n)+[^\S\n]*(?:-{{1,2}}[^\S\n]*)?", text):
            if span := self._full_name(text, m.end()):
                if re.match(r"[^\S\n]*(?:$|\r|\n|\\n|\"|  )", text[span[1] : span[1] + 6]):
                    add((*span, "name"))

    @staticmethod
    def _phone(text: str, low: str, m: re.Match, add) -> None:
        value = m[0]
        digits = sum(map(str.isdigit, re.sub(r"(?i)\s?(?:ext\.?|x|extension|durchwahl|poste)\s?\d+$", "", value)))
        before = text[max(0, m.start() - 40) : m.start()]
        if not 7 <= digits <= 15 or _NOT_PHONE.search(before[-24:]):
            return
        if not value.startswith(("+", "(", "0")):
            cued = any(c in low[max(0, m.start() - 48) : m.start()] for c in _PHONE_CUES) or re.search(r"\|[^\S\n]*$", before) or "ext" in value.lower()
            alone = re.search(r"(?:^|\n|\\n)[^\S\n]*$", before) and re.match(r"[.\s]|$", text[m.end() : m.end() + 1])
            if digits < 10 and not (cued or alone):
                return
            if not (cued or alone or value.startswith("1-")) and "." in value:
                return
        if re.fullmatch(r"\d{4}[-. ]\d\d[-. ]\d\d.*", value) or re.fullmatch(r"0\.\d+", value):
            return
        add((*m.span(), "phone"))


def _without_overlaps(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in order; of overlapping ones of a kind the longest, of others email, number and address go before name and phone."""
    order = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(found), key=lambda x: (order[x[2]], x[0] - x[1], x[0])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its type in brackets, such as ``[EMAIL]``."""
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def find_pii(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``record_id, field, pii_type``: a row for each kind of personal information in each field.

    Null and empty texts give no row, repeated rows the same rows again (callers that count records take
    distinct ones), a null key a null record id; other columns are ignored.
    """

    def make():
        finder = Finder()

        def look(rows: dict) -> dict:
            out: dict[str, list] = {"record_id": [], "field": [], "pii_type": []}
            for name in fields:
                for k, text in zip(rows["_key"], rows[name]):
                    for kind in sorted({kind for *_, kind in finder.find(text)}):
                        out["record_id"].append(k)
                        out["field"].append(name)
                        out["pii_type"].append(kind)
            return out

        return look

    return map_lists(df.select(F.col(key).cast("string").alias("_key"), *fields), make, "record_id string, field string, pii_type string")


def mask_pii(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and ``fields`` of each row with typed placeholders for personal information; nulls stay null."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        finder = Finder()
        return lambda rows: {key: rows[key]} | {f: [t and mask(t, finder.find(t)) for t in rows[f]] for f in fields}

    return map_lists(df.select(key, *fields), make, f"`{key}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))
