"""URL filters and chat formatting: equality with SQL, edges, plans without Python."""

from sessionlens.llm import queries
from sessionlens.llm.chat import format_preferences, ordered_turns
from sessionlens.llm.url_filter import RULES, judge_urls

from ..helpers import duck_rows, spark_rows

import pytest


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert spark_rows(df) == duck_rows(queries.ORACLE_SQL[name], small)
    if not name.startswith(("op8_", "op9_")):
        return
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def judged(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    return {r.page_id: r for r in judge_urls(pages, RULES, **more).collect()}


def test_rules_hosts_and_paths(spark):
    urls = ["HTTP://WWW.Example.ORG/es/x?a#b", "http://example.org/en/19", "http://org/x", "http://notorg/x", None, "no scheme", "http://a.com?x/fr/", "http://a.com/fr/1", "x://a.com/de/#f", "http://example.org"]
    got = judged(spark, [(i, u, None, "clash") for i, u in enumerate(urls)])
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("www.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/19", "example.org/en/1"), ("org", "/x", "org/"), ("notorg", "/x", None), ("", "", None), ("", "", None),
        ("a.com", "", None), ("a.com", "/fr/1", "com/fr/"), ("a.com", "/de/", "com/de/"), ("example.org", "", None),
    ]
    assert got[0].verdict == "block" and got[7].verdict == "allow" and got[4].verdict == "allow"


def test_distrust_flows_backwards(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.com/de/1", None, ""), (2, "http://spam.net/1", link("bad.com", "bad.com"), ""), (3, "http://good.org/x", link("fine.net"), ""), (4, "http://fine.net/a", link("good.org") + '<a href="/own">', ""), (5, "http://alone.net/", "<a href='#'>", "")]
    got = judged(spark, rows)
    assert {i: got[i].verdict for i in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert got[2].distrust > 0 and got[4].trust > 0 and got[5].trust is None
    assert judged(spark, rows[4:])[5].verdict == "allow"  # no seeds


def test_distrust_reaches_the_end_of_a_chain(spark):
    """h0 links to h1 and so on, h9 to a blocked host; ranks against the solution of their equations."""
    rows = [(0, "http://bad.com/de/1", None, "")] + [(k, f"http://h{k}.net/", f'<a href="http://h{k + 1}.net/">', "") for k in range(1, 10)]
    rows.append((10, "http://h10.net/", '<a href="http://bad.com/x">', ""))
    got = judged(spark, rows)
    assert {got[k].verdict for k in got} == {"block"}
    rank = {0: 1.0}
    for k in range(10, 0, -1):
        rank[k] = 0.85 * rank[(k + 1) % 11]
    assert all(abs(got[k].distrust - rank[k] / sum(rank.values())) < 1e-5 for k in got)


def test_empty_pages(spark):
    assert judged(spark, []) == {}


def test_preferences(spark):
    rows = [("p", "chosen", 0, "user", "hi"), ("p", "chosen", 1, "assistant", "yes"), ("p", "chosen", 2, "user", "ok"), ("p", "rejected", 0, "user", "hi"), ("p", "rejected", 1, "assistant", "no"), ("q", "chosen", 0, "user", "a"), ("q", "rejected", 0, "user", "a"), ("r", "chosen", 0, "assistant", "")]
    got = {r.pair_id: r for r in format_preferences(spark.createDataFrame(rows, "pair_id string, side string, pos int, role string, text string")).collect()}
    p, q, r = got["p"], got["q"], got["r"]
    assert p.n_common == 1 and p.prompt == "<|user|>\nhi<|end|>\n" and p.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n" and p.rejected == "<|assistant|>\nno<|end|>\n"
    assert p.chosen_mask == [0, 1, 0, 0] and p.rejected_mask == [0, 1] and "".join(p.chosen_segments) == p.chosen
    assert (q.n_common, q.chosen, q.rejected) == (1, "", "") and (r.n_common, r.prompt, r.rejected) == (0, "", "")


def test_turn_order_and_nulls(spark):
    rows = [(1, 5, "user", "b"), (1, None, None, None), (1, 5, "assistant", "a"), (1, 5, "user", "b"), (None, 0, "user", "lost")]
    got = ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("pos").collect()
    assert [(r.pos, r.role, r.text) for r in got] == [(0, "user", ""), (1, "assistant", "a"), (2, "user", "b"), (3, "user", "b")]
