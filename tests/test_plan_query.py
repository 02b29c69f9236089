import pytest

from sessionlake.plans.query import Filters, Query, QueryError, cursor, fingerprint, resume, validate


@pytest.mark.parametrize(
    "query",
    [
        Query("nothing"),
        Query("sessions", limit=0),
        Query("sessions", limit=201),
        Query("messages", offset=3),
        Query("sessions", after=("a", 1)),
        Query("sessions", offset=-1),
        Query("sessions", Filters(role="user")),
        Query("messages", Filters(role="system")),
        Query("messages", Filters(providers=("codex", "codex"))),
        Query("messages", Filters(providers=("nobody",))),
        Query("messages", Filters(message_after="soon")),
        Query("messages", Filters(message_after="2024-02-01", message_before="2024-01-01")),
        Query("tool_calls", fields=("input_text",)),
        Query("sessions", fields=("a", "a")),
        Query("sessions", fields=()),
    ],
)
def test_refused(query):
    with pytest.raises(QueryError):
        validate(query)


def test_cursors_hold_query_and_snapshot():
    q = Query("messages", Filters(role="user"), limit=10)
    text = cursor(q, "c:1", ("s", 4))
    assert resume(q, text, "c:1").after == ("s", 4)
    assert resume(Query("sessions", limit=10), cursor(Query("sessions", limit=10), "c:1"), "c:1").offset == 10
    with pytest.raises(QueryError, match="expired"):
        resume(q, text, "c:2")
    with pytest.raises(QueryError, match="another"):
        resume(Query("messages"), text, "c:1")
    with pytest.raises(QueryError, match="unreadable"):
        resume(q, "???", "c:1")
    assert fingerprint(q) == fingerprint(Query("messages", Filters(role="user"), limit=10, after=("x", 1)))
