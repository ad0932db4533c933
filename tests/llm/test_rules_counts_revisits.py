"""URL filters, token counts and WARC revisits: DuckDB, brute force and odd rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import catalog, tokencounts, urlfilter, warc
from cohortlens.plans import joins
from tests.llm.helpers import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
    o = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in o.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in o.fetchall()), key=key)


# ------------------------------------------------------------------ URL filters
URLS = [None, "", "no scheme", "http://Example.ORG/es/x", "http://a.example.org/en/16?q#f", "https://example.org", "x://org/",
        "http://badexample.org/es/", "http://m.com/fr/1", "http://m.com/de/1", "http://com/de/", "http://m.com/De/1",
        "http://adult-x.net/a", "http://adulty.net/", "http://b.net/adult", "ftp://é.org/es/://x", "http://x.com#/fr/", "a://b://org/"]


def judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, best[0], best[1]
    import re

    return host, path, None, "block" if re.search(r"\b(" + "|".join(urlfilter.WORDS) + r")\b", host, re.ASCII) else "allow"


def test_judge_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS * 2)], "page_id int, url string, html string, token string")
    got = urlfilter.judge(pages, urlfilter.rule_table(spark)).collect()
    expect = [(i, *judge(u, urlfilter.RULES)) for i, u in enumerate(URLS * 2)]
    assert sorted(tuple(r) for r in got) == sorted(expect, key=lambda r: r[0])
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark)).count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_many_rules_and_rules_without_a_token(spark, monkeypatch, bound):
    if bound is not None:  # the index is shuffled instead
        monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", bound)
    rnd = random.Random(2)
    hosts = [f"{a}.{b}" for a in ("aa", "bb", "cc") for b in ("com", "net")]
    rules = list({f"{rnd.choice(hosts)}/{rnd.choice(['', 'x', 'x/', 'y/z', 'y'])}": rnd.choice(["allow", "block"]) for _ in range(30)}.items())
    rules = [(v, r) for r, v in rules]
    urls = [f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}/{rnd.choice(['', 'x', 'xx', 'x/1', 'y/z', 'y/zz', 'Y'])}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    table = urlfilter.rule_table(spark, rules, patterns=[("digits", r"/\d+$", [])])
    for r in urlfilter.judge(pages, table).collect():
        host, path, rule, verdict = judge(urls[r["page_id"]], rules)
        if rule is None and path.rsplit("/", 1)[-1].isdigit():
            verdict = "block"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_tokens_are_read_off_expressions():
    want = {r"^[^/]*\badult\b[^/]*(/|$)": ["adult"], r"/\d+$": [], r"/ads/x?y/": ["ads"], r"^(www)\.shop\.": ["shop", "www"],
            r"(?i)/ads/": [], r"/(ads|pix)/": [], r"/ads?/": [], r"/(ads)+/": [], r"\bfoo-bar2\b": ["bar2", "foo"], r"foo": [],
            r"/foo": [], r"foo$": [], r"^foo$": ["foo"], r"/a{2}/b/": ["b"], r"[": [], r"/é/ok/": ["ok"], r"/x(?!y)/z/": ["z"]}
    for pattern, tokens in want.items():
        assert urlfilter.literal_tokens(pattern) == tokens, pattern


def test_generated_expressions_equal_running_them_all(spark):
    """The index by rarest derived token loses no match: every url against every rule, by Python's own engine."""
    import re

    rnd = random.Random(7)
    parts = ["ads", "pix", "a1", "shop", "x", "track"]
    shapes = [r"/{}/", r"\b{}\b", r"^[^/]*\.{}\.", r"/{}/{}(/|$)", r"/({}|{})/", r"{}-?{}", r"/{}s?/", r"/{}/\d+$", r"^{}\.", r"/{}$"]
    rules = []
    for i in range(120):
        shape = rnd.choice(shapes)
        rules.append((f"r{i}", shape.format(*(rnd.choice(parts) for _ in range(shape.count("{}"))))))
    urls = ["http://" + rnd.choice(["", "w.", "ads."]) + rnd.choice(parts) + rnd.choice([".com", ".ads.net", "-x.org"]) + "/"
            + "/".join(rnd.choice([*parts, "adss", "12", "xads", "ads-pix", ""]) for _ in range(rnd.randrange(4))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, urlfilter.rule_table(spark, [], rules)).collect()}
    assert sum(bool(urlfilter.literal_tokens(p)) for _, p in rules) > 40
    for i, u in enumerate(urls):
        subject = u.split("://", 1)[1]
        assert got[i] == ("block" if any(re.search(p, subject) for _, p in rules) else "allow"), u


# ------------------------------------------------------------------ token counts
CHANGE = "doc_id bigint, version string, op string, source string, lang string, tokens bigint, seq int, live string"


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}


def batch(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], CHANGE)


def test_rollup_inserts_revises_deletes_once(spark, tmp_path):
    r = tokencounts.Rollup(spark, f"file://{tmp_path}/roll")
    assert totals(r) == {}
    first = batch(spark, [(1, "v1", "upsert", "a", "en", 10, 0), (2, "v1", "upsert", "a", None, 5, 0), (3, "v1", "upsert", None, "en", 7, 0),
                          (3, "v1", "upsert", None, "en", 7, 0), (4, "v1", "upsert", "a", "en", None, 0), (None, "v1", "upsert", "a", "en", 3, 0),
                          (5, "v1", "other", "a", "en", 3, 0), (6, "v2", "delete", "a", "en", None, 0), (7, None, "upsert", "a", "en", 1, 0)])
    assert r.apply("one", first) and not r.apply("one", first)
    assert totals(r) == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 5), (None, "en", "v1"): (1, 7)}
    assert r.apply("two", batch(spark, [(1, "v1", "upsert", "b", "en", 12, 0), (1, "v1", "upsert", "b", "en", 11, 1), (2, "v1", "delete", None, None, None, 0),
                                        (3, "v1", "upsert", None, "en", 9, 0), (3, "v1", "delete", None, "en", None, 0)]))
    assert totals(r) == {("b", "en", "v1"): (1, 11)}
    assert r.apply("three", batch(spark, [(2, "v1", "upsert", "a", "en", 0, 0), (2, "v2", "upsert", "a", "en", 4, 0)]))
    assert not r.apply("two", batch(spark, [(1, "v1", "delete", None, None, None, 0)]))
    assert r.apply("none", batch(spark, []))
    assert totals(tokencounts.Rollup(spark, f"file://{tmp_path}/roll")) == {
        ("b", "en", "v1"): (1, 11), ("a", "en", "v1"): (1, 0), ("a", "en", "v2"): (1, 4)}


def test_failed_attempt_leaves_nothing_and_can_be_sent_again(spark, tmp_path, monkeypatch):
    r = tokencounts.Rollup(spark, f"file://{tmp_path}/roll")
    rows = batch(spark, [(1, "v1", "upsert", "a", "en", 10, 0)])
    real = spark.createDataFrame

    def broken(*a, **k):
        if len(a) > 1 and a[1] == tokencounts.COMMIT:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        r.apply("one", rows)
    monkeypatch.undo()
    assert totals(r) == {}
    assert r.apply("one", rows) and totals(r) == {("a", "en", "v1"): (1, 10)}


def test_random_batches_equal_a_plain_ledger(spark, tmp_path):
    """Stale, tied and null seqs over batches that are compacted every third; brute force on one dict."""
    rnd = random.Random(8)
    roll, state = tokencounts.Rollup(spark, f"file://{tmp_path}/roll", compact_every=3), {}
    for number in range(8):
        rows = [(rnd.randint(1, 12), rnd.choice(["v1", "v2"]), rnd.choice(["upsert", "upsert", "delete"]), rnd.choice(["a", "b", None]),
                 rnd.choice(["en", None]), rnd.randint(0, 50), rnd.choice([None, 1, 2, 3, 4])) for _ in range(rnd.randint(0, 14))]
        least = lambda x: (x is not None, x or 0)
        best = {}
        for doc, version, op, source, lang, tokens, seq in rows:
            rank = (least(seq), op == "delete", tokens, (source is not None, source or ""), (lang is not None, lang or ""))
            if (doc, version) not in best or rank > best[doc, version][0]:
                best[doc, version] = (rank, (op, source, lang, tokens, seq))
        for k, (_, change) in best.items():
            if k not in state or least(change[4]) >= least(state[k][4]):
                state[k] = change
        assert roll.apply(f"b{number}", batch(spark, rows))
        want = {}
        for (_, version), (op, source, lang, tokens, _) in state.items():
            if op == "upsert":
                n, t = want.get((source, lang, version), (0, 0))
                want[source, lang, version] = (n + 1, t + tokens)
        assert totals(roll) == want
        assert len(roll.commits()) <= 4
    assert roll.compact() and totals(roll) == want and len(roll.commits()) == 1 and not roll.compact()
    assert not roll.apply("b0", batch(spark, rows)), "batches before a compaction stay committed"


def test_a_small_batch_reads_its_own_folders_of_the_state(spark, tmp_path):
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/roll")
    roll.apply("one", batch(spark, [(i, "v1", "upsert", "a", "en", i, 0) for i in range(2000)]))
    whole = roll.state(roll.commits())
    some = roll.state(roll.commits(), [5, 9])
    assert whole.select("bucket").distinct().count() == tokencounts.BUCKETS
    assert {r["bucket"] for r in some.select("bucket").distinct().collect()} == {5, 9}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:120]


def test_a_batch_that_died_leaves_nothing(spark, tmp_path, monkeypatch):
    roll = tokencounts.Rollup(spark, f"file://{tmp_path}/roll")
    roll.apply("one", batch(spark, [(1, "v1", "upsert", "a", "en", 3, 0)]))
    monkeypatch.setattr(roll, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    two = batch(spark, [(1, "v1", "delete", None, None, None, 1), (2, "v1", "upsert", "a", "en", 9, 0)])
    with pytest.raises(OSError):
        roll.apply("two", two)
    with pytest.raises(OSError):
        tokencounts.Rollup.apply(roll, "two", two)
    monkeypatch.undo()
    assert totals(roll) == {("a", "en", "v1"): (1, 3)}
    assert roll.apply("two", two) and totals(roll) == {("a", "en", "v1"): (1, 9)}


def test_page_records_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>"), (1, "http://a/x", "<p>"), (None, "http://a/x", "<p>"), (2, None, "<p>"), (3, "http://a/x", None),
            (4, "no url", ""), (5, "https://www.A/x.html", "é" * 50_000), (None, None, None)]
    for name, some in (("a", rows), ("b", [])):
        pages = spark.createDataFrame(some, "page_id bigint, url string, html string").withColumns(
            {c: F.lit("x") for c in ("ts", "kind", "curl", "slice", "found", "headers")})
        pages.coalesce(1).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = warc.op3(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 2 * len(some)  # two revisits a row, whatever it holds
        for r in got:
            if r["record_id"] is None or r["canonical_url"] is None:
                assert r["status"] == "orphan" and r["headers"] is None
    last = {r["record_id"]: r["status"] for r in warc.op3(spark, f"{tmp_path}/a").collect()}
    # page 5 is the newest capture of a/x that the last visits meet; page 3 has nothing to prove with
    assert (last["5-c"], last["1-c"], last["3-c"], last["1-a"]) == ("resolved", "mismatch", "unproved", "orphan")


def test_token_functions(spark):
    rows = [None, "", " \t", "a b,c 12 !! é東", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in rows], "text string").select(
        tokencounts.space_tokens(F.col("text")).alias("s"), tokencounts.run_tokens(F.col("text")).alias("r"))
    assert [tuple(x) for x in df.collect()] == [(0, 0), (0, 0), (0, 0), (5, 8), (1, 1)]


# ------------------------------------------------------------------ WARC
REC = "record_id string, kind string, url string, ts bigint, etag string, last_modified string, headers map<string,string>, digest string, slice int"


def resolve(records):
    out = {}
    for r in records:
        if r[1] != "revisit":
            continue
        rid, _, url, ts, etag, modified, headers, _ = r
        curl = canon(url)
        earlier = [x for x in records if x[1] == "response" and canon(x[2]) == curl and curl is not None
                   and x[3] is not None and ts is not None and x[3] < ts]
        if not earlier:
            out.setdefault(rid, []).append(("orphan", None, None, None))
            continue
        best = max(earlier, key=lambda x: (x[3], x[0]))
        weak = lambda e: e[2:] if e and e.startswith("W/") else e
        if etag is not None:
            status = "resolved" if weak(etag) == weak(best[4]) else "mismatch"
        elif modified is not None:
            status = "resolved" if modified == best[5] else "mismatch"
        else:
            status = "unproved"
        merged = {**(best[6] or {}), **{k: v for k, v in (headers or {}).items() if k not in warc.KEPT}} if status == "resolved" else None
        out.setdefault(rid, []).append((status, best[0], best[7] if status == "resolved" else None, merged))
    return out


def canon(url):
    return {"http://a/x": "a/x", "https://www.A/x.html": "a/x", "http://m.a/x/?utm_q=1#f": "a/x", "http://a/y?b=1&ref=z": "a/y?b=1",
            "http://A/y?b=1": "a/y?b=1"}.get(url)


def test_revisits_against_brute_force(spark):
    rnd = random.Random(7)
    urls = ["http://a/x", "https://www.A/x.html", "http://m.a/x/?utm_q=1#f", "http://a/y?b=1&ref=z", "http://A/y?b=1", None, "plain"]
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "revisit"])
        rows.append((f"r{i:03}", kind, rnd.choice(urls[:2] * 4 + urls), rnd.choice([None, *range(60)]), rnd.choice(['"1"', 'W/"1"', '"2"', None]),
                     rnd.choice(["mon", "tue", None]), rnd.choice([None, {}, {"date": str(i), "content-length": "0", "x": "y"}]), f"d{i}" if kind == "response" else None))
    rows.append(next(r for r in rows if r[1] == "revisit"))  # a repeated row
    df = spark.createDataFrame([(*r, 1) for r in rows], REC)
    got = {}
    for r in warc.resolve(df).collect():
        got.setdefault(r["record_id"], []).append((r["status"], r["response_id"], r["digest"], r["headers"]))
    assert got == resolve(rows)
    assert {s for v in got.values() for s, *_ in v} == {"orphan", "resolved", "mismatch", "unproved"}


def test_no_records(spark):
    assert warc.resolve(spark.createDataFrame([], REC)).count() == 0
    only = spark.createDataFrame([("a", "revisit", "http://a/x", 5, '"1"', None, None, None, 1)], REC)
    assert [r["status"] for r in warc.resolve(only).collect()] == ["orphan"]


# ------------------------------------------------------------------ token counts of odd tables
def test_token_counts_equal_their_sql_on_odd_and_empty_tables(spark, tmp_path):
    from tests.llm.helpers import ROWS, odd

    more = [(1, "zeta ... other text", "es", "s9", 1), (1, None, None, None, None), (11, "one", "en", None, 3), (12, "one", "en", "s1", 3),
            (13, None, "en", "s1", 0), (14, None, "en", "s1", 0), (15, "- a -- b !", None, "s2", 1), (15, "- a -- b !", "en", "s2", 1)]
    for name, rows in (("a", ROWS + more), ("b", [])):
        odd(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        df = tokencounts.op5(spark, f"{tmp_path}/{name}")
        c = duckdb.connect()
        c.execute(f"create view documents as select * from read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        cols = ["source", "lang", "version", "documents", "tokens"]
        got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
        assert got == sorted(c.execute(f"select {', '.join(cols)} from ({tokencounts.OP5_SQL})").fetchall(), key=key)
        assert bool(got) == bool(rows)
