import pytest

from sessionlake.llm.pii import Finder, find_pii, mask, mask_pii


@pytest.fixture(scope="module")
def finder():
    return Finder()


FOUND = [
    ("write to ana.lopez+x@mail.example today", "email"),
    ("write to mailto:ana@mail.example", "email"),
    ("ana [at] mail [dot] example", "email"),
    ("ana (at) mail.example", "email"),
    ("ana.lopez at mail dot example", "email"),
    ("A.LOPEZ@MAIL.EXAMPLE", "email"),
    ("call me on 01.99.00.33.22.", "phone"),
    ("llama al +49 30 23125 106", "phone"),
    ("+1 (212) 555-0174", "phone"),
    ("the number is 555-0188", "phone"),
    ("tel: (01632) 960 477", "phone"),
    ("TEL;TYPE=cell:030/23125693", "phone"),
    ("1-800-555-0178 ext. 73", "phone"),
    ("fixture: SSN 901-20-3697", "id_number"),
    ("the social security no. 932 91 1633 was pasted", "id_number"),
    ("passport X92447721 in row 3", "id_number"),
    ("DNI 36784728-C in row 3", "id_number"),
    ("Steuer-ID 69 476 444 908 in row 3", "id_number"),
    ("national id: 392083-2325-9 in row 8973", "id_number"),
    ("QQ 49 11 67 C", "id_number"),
    ("goes to 117 rue des Lilas Blancs, 28662 Valmont, attention", "address"),
    ("<td>Lindenweg 83, 52883 Altbruck</td>", "address"),
    ("Calle del Pino Alto 183, 2º B, Villanueva", "address"),
    ("Delivered to: 218 Harrow Rd, Stonefield", "address"),
    ("209 Maple Road, Apt 30B, Lower Hill 77781", "address"),
    ("P.O. Box 90, Stonefield", "address"),
    ("This bug was reported by Ana Maria Lopez last night.", "name"),
    ("Ask Dr. Lopez before you merge", "name"),
    ("Author: Ana Lopez <ana@mail.example>", "name"),
    ("signed-off-by Lopez, Ana", "name"),
    ("reporter=ana o'brian ticket=12", "name"),
    ("my name is ANA LOPEZ and I own this", "name"),
    ("Thanks,\nAna B. Lopez", "name"),
    ("INSERT INTO contacts VALUES (7, 'Ana Lopez', 'x');", "name"),
    (" 4959 | Ana D. Lopez | +49 30 23125474 | open", "name"),
    ("12,Ana Lopez,ana@mail.example,active", "name"),
    ("Ana Lopez asked for this on the call", "name"),
]
NONE = [
    "Cloned git@forge.example:team/repo.git into the workspace.",
    "Bump @acme/session@5.26.5 and reinstall.",
    "@decorator usage in a/b.py is fine.",
    "postgres://svc:abc@db.example:5432/x",
    "Trace id 578af288-5c15-de66-a52832aab624.",
    "Build 2026.41.2879-rc9 is the last good one.",
    "Epoch 1767735729298 is in milliseconds.",
    "2026-05-02T11:19:59.756Z INFO walk limit=94",
    "The Merge Queue and the Dead Letter Box share one table.",
    "Ask the reviewer before you merge.",
    "signed-off-by the build bot",
    "-rw-r--r-- 1 dev dev 26707 2026-05-08 16:55 a/b.py",
    "order no. 555-0188 and ticket 123-4567",
    "duplicate applicant social security card",
    "",
]


@pytest.mark.parametrize("text,kind", FOUND)
def test_found(finder, text, kind):
    spans = finder.find(text)
    assert kind in {k for *_, k in spans}, spans
    assert f"[{kind.upper()}]" in mask(text, spans)


@pytest.mark.parametrize("text", NONE)
def test_not_found(finder, text):
    assert finder.find(text) == []


def test_a_name_inside_an_email_is_none(finder):
    assert {k for *_, k in finder.find("ana.lopez@mail.example")} == {"email"}


def test_boundaries(finder):
    text = "Ask Ana Lopez before you merge, or write to ana@mail.example."
    assert mask(text, finder.find(text)) == "Ask [NAME] before you merge, or write to [EMAIL]."


SCHEMA = "id string, a string, _key string, pii_type string"


def test_rows(spark):
    rows = [("1", "ana@mail.example bob@mail.example", "x", "y"), ("1", "ana@mail.example bob@mail.example", "x", "y"), ("2", None, None, None), ("3", "", None, None), (None, "x " * 200_000 + "ana@mail.example", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["record_id"] or "", r["pii_type"]) for r in find_pii(df, "id", ["a"]).collect()) == [("", "email"), ("1", "email"), ("1", "email")]
    masked = {r["id"]: r["a"] for r in mask_pii(df, "id", ["a"]).collect()}
    assert masked["1"] == "[EMAIL] [EMAIL]" and masked["2"] is None and masked["3"] == ""
    assert find_pii(spark.createDataFrame([], SCHEMA), "id", ["a"]).count() == 0


@pytest.mark.parametrize(
    "text,value,kind",
    [
        ("I spoke with Maria Gonzalez about it", "Maria Gonzalez", "name"),
        ("Jonathan Meyer will join", "Jonathan Meyer", "name"),
        ("Hi John Smith, thanks", "John Smith", "name"),
        ("Dr. Weber and Aisha Khan came", "Aisha Khan", "name"),
        ("Kontakt: Anna-Lena Vogt", "Anna-Lena Vogt", "name"),
        ("田中さんに聞いてください", "田中さん", "name"),
        ("It is 221B Baker Street, London NW1 6XE now", "221B Baker Street, London NW1 6XE", "address"),
        ("write to " + "a" * 90 + "@mail.example soon", "a" * 90 + "@mail.example", "email"),
        ("reported by " + "Anne" + "b" * 100 + " Smith.", "Anne" + "b" * 100 + " Smith", "name"),
        ("at 12 " + "Long" + "g" * 90 + " Street, Springfield", "12 " + "Long" + "g" * 90 + " Street, Springfield", "address"),
    ],
)
def test_found_by_shape_and_at_any_length(text, value, kind):
    assert (text.index(value), text.index(value) + len(value), kind) in Finder().find(text)


@pytest.mark.parametrize("text", ["Maria DB server runs", "Mark the Build as done", "James Bond Street Project", "Frank Server restarted", "仕様を確認", "お客様とユーザー様"])
def test_no_names(text):
    assert not [s for s in Finder().find(text) if s[2] == "name"]
