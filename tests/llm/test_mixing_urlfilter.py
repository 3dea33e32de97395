"""The two SQL-only operators against plain Python; DuckDB runs the oracles on the driver's tables."""

import hashlib
import re

import duckdb
import pytest

from filigree.llm import mixing, queries, urlfilter

SF = "/root/testdata/sf0.001"


def plain_mix(rows, max_epochs=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = {}
    for d, t, s in rows:
        own.setdefault(s, []).append((hashlib.md5(("7" if d is None else f"{d}#7").encode()).hexdigest(), d, size(t)))
    names = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(z for _, _, z in own[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if max_epochs * total[s] < level * weight[s] - 1e-9]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(max_epochs * total[s])
            left -= target[s]
            open_.remove(s)
    out = []
    for s in names:
        budget = min(round(target[s]), max_epochs * total[s])
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, d, z in sorted(own[s], key=lambda v: (v[0], -1 if v[1] is None else v[1], v[2])):
            part = max(0, min(z, rest))
            rest -= part
            out.append((d, z, total[s], round(target[s], 6), whole * z + part))
    return out


CASES = [
    [],
    [(1, "a b c", "x")],
    [(1, None, "x"), (2, "", None), (3, " \n", "y")],
    [(i, "w " * (i % 7), ["a", "b", None, "Ä", "z"][i % 5]) for i in range(200)],
    [(i, "w " * 50, "big") for i in range(80)] + [(100 + i, "one two", s) for i, s in enumerate("cdefg")],
    [(5, "a b", "s"), (5, "a b", "s"), (5, "a b c", "s"), (None, "q r s", "t"), (None, "q r s", "t")],
    [(1, "x " * 50_000, "s"), (2, "y", "t")],
]


@pytest.mark.parametrize("rows", CASES)
def test_mix_is_exact(spark, rows):
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, size int")
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df).collect())
    want = sorted((str(a), *b) for a, *b in plain_mix(rows))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-4 for g, w in zip(got, want))
    assert all(g[4] <= 3 * g[1] for g in got)


def test_repeats_of_whole_rows(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s" if i < 30 else "t") for i in range(36)], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    out = mixing.repeated(df, mixed)
    assert out.columns == df.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(times.get(r["doc_id"], 0) == -(-r["taken"] // r["size"]) for r in mixed.collect())


def test_given_weights(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s" if i < 30 else "t") for i in range(60)], "doc_id long, text string, source string")
    w = spark.createDataFrame([("s", 3.0), ("t", 1.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.mix(df, weights=w).collect()}
    assert got == {"s": 450.0, "t": 150.0}


RULES = [*queries.URL_RULES, ("a.b.com", "", "block"), ("", "/x", "block"), ("com", "/en/", "block")]


def plain_filter(url, rules, default="allow"):
    i = (url or "").find("://")
    rest = url[i + 3 :] if i >= 0 else ""
    m = re.match(r"[^/?#]*", rest)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
    path = re.match(r"[^?#]*", rest[m.end() :])[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def test_urls_by_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/7", "https://www.example.com/en/71?q#f", "http://notexample.com/en/7", "ftp://x.example.net/de/8/9", "http://org/es/", "http://a.b.org?x=/es/",
            "http://a.b.com", "http://c.a.b.com:80/en/", "http://u@com/en/", "http://com#/en/", "://com/en/", "http://x/x", "http://é.com/en/ü", "http://a..com/en/", "http://h.com/" + "p/" * 5000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[4]), (4, urls[4])]
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, host string, rule string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in urlfilter.filter_urls(df, rules).collect())
    assert got == sorted(str((i, *plain_filter(u, RULES))) for i, u in rows)


def test_urls_without_pages_or_rules(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    got = urlfilter.filter_urls(one, rules.limit(0)).first()
    assert (got["rule"], got["verdict"]) == (None, "allow")


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_url_filter"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    r = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in r.description]
    show = lambda row: str([round(v, 4) if isinstance(v, float) else v for v in row])
    assert sorted(show(x) for x in r.fetchall()) == sorted(show([x[c] for c in names]) for x in df.collect())


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    want = {"http://a.com/en/1": "block", "http://www.example.com/en/71": "allow", "http://a.net/de/1": "allow", "http://example.net/de/7": "allow", "http://example.net/de/81": "block", "http://b.org/es/": "block", "http://b.org/en/": "allow"}
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.queries()["op3_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
