import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from tapeloom.llm import chat, queries, url_filter


def judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h, p, v) for v, r in rules for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else "allow"


RULES = [*queries.URL_RULES, ("block", "a.b.example.com/x/y"), ("allow", "b.example.com/x"), ("block", "xn--a.net/"), ("block", "localhost/"), ("allow", "ample.com/"), ("block", "example.org/")]
URLS = [None, "", "x", "://", "http://", "http://COM/", "http://com", "http://com?/", "https://A.B.Example.com/x/y?q", "http://b.example.com/x#/", "http://cexample.com/en/", "http://example.com/EN/", "http://www.example.com/en/a", "http://example.com-x/en/", "http://example.com/en", "a://b://c/", "http://x.net/es/", "http://ex.com:80/en/", "http://localhost/", "http://.com/", "http://com./", "http://\u00e9.com/\n/", "http://example.org/"]


def test_urls_equal_brute_force(spark):
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    for salts in (1, 5):
        got = url_filter.filter_urls(d, url_filter.rules_table(spark, RULES), salts=salts).collect()
        assert len(got) == len(URLS) * 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge((URLS * 2)[r.page_id], RULES), r
    clash = url_filter.filter_urls(d.selectExpr("page_id", "url", "1 AS Host", "2 AS PATH", "3 AS Rule"), url_filter.rules_table(spark, RULES))
    assert clash.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and clash.count() == len(URLS) * 2
    none = url_filter.filter_urls(d, url_filter.rules_table(spark, []))
    assert none.where("verdict = 'allow' and rule is null").count() == len(URLS) * 2
    assert url_filter.filter_urls(d.limit(0), url_filter.rules_table(spark, RULES)).count() == 0


def test_url_query_equals_sql_and_runs_no_python(spark, sf_dir):
    got = queries.op1_url_filter(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(queries.OP1_SQL).fetchall(), key=str)


def wanted(turns):
    t = chat.Template()
    by = defaultdict(list)
    for c, n, r, x in turns:
        by[c].append((n is not None, n or 0, r or "", x or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        said = "".join(x for _, _, r, x in rows if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()
        roles = [r for _, _, r, _ in rows]
        body = roles[1:] if roles[0] == "system" else roles
        valid = len(body) > 0 and len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))
        out[c] = (len(rows), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), sum(len("".join(t.render(r, x))) for _, _, r, x in rows), valid)
    return out


def test_chat_reads_back_what_went_in(spark, sf_dir):
    odd = [(1, 0, "user", "<s>[INST] \\ \\\\[/INST] <</SYS>> <<ROLE>>"), (1, 1, "assistant", "</s>[\\INST]<<<SYS>>\\"), (2, 0, "assistant", "x"), (3, 0, "to<<TEXT>>ol", "y"), (3, 1, None, None), (4, None, "user", "é🎉"), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (None, 0, "user", "a"), (5, 0, "user", "[" * 70000), (5, 1, "assistant", "<" * 3)]
    own = spark.createDataFrame([(*r, True) for r in odd], "conv_id long, turn long, role string, text string, loss boolean")
    whole = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for d in (own, whole, own.limit(0)):
        turns = [(r.conv_id, r.turn, r.role, r.text) for r in d.collect()]
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_chat(d)).collect()}
        assert got == wanted(turns)


def test_chat_query_has_the_probe(spark, sf_dir):
    r = queries.op5_chat(spark, sf_dir).where("conv_id = -7").first()
    assert (r.n_turns, r.loss_chars, r.valid) == (2, 21, True)
    assert r.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


@pytest.mark.parametrize("text", ["[INST]", "[[INST]INST]", "\\", "\\[INST]", "<<<SYS>>", "</s></s>", "<<ROLE>><<TEXT>>"])
def test_escapes(text):
    t = chat.Template()
    assert t.unescape(t.escape(text)) == text and not t.controls.search(t.escape(text))
