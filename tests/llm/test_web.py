"""Mixing and url trust against plain Python, and the pipeline stage by stage."""

import hashlib

import pytest

import corpus_pipeline
from logwarden.llm import mixing, url_trust
from logwarden.llm.tables import QUERIES, table
from logwarden.session import materialize
from tests.llm.cases import awkward, documents, empty

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", "1", 100), ("a", "y", "2", 50), ("b", "x", "2", 5), ("b", "y", "1", 20), ("b", "y", "2", 0)],
                                  "source string, lang string, topic string, mass long")
    got = [r.asDict() for r in mixing.rake(cells, rounds=60).collect()]
    total = 175.0
    for column, power in mixing.POWERS.items():
        shares = {}
        for r in cells.collect():
            shares[r[column]] = shares.get(r[column], 0) + r.mass / total
        whole = sum(s ** power for s in shares.values())
        for value, share in shares.items():
            assert abs(sum(r["fit"] for r in got if r[column] == value) - share ** power / whole) < 1e-3
    assert len(got) == 4


def test_raking_goes_on_until_correlated_cells_fit(spark, recwarn):
    rows = [(f"s{k}", f"l{j}", "1", (1000 + 5000 * (k == 0)) * (97 if j == k % 3 else 4)) for k in range(6) for j in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass long")
    got = mixing.rake(cells).collect()
    total = sum(r[3] for r in rows)
    for at, column in enumerate(("source", "lang")):
        shares = {}
        for r in rows:
            shares[r[at]] = shares.get(r[at], 0) + r[3] / total
        whole = sum(s ** mixing.POWERS[column] for s in shares.values())
        for value, share in shares.items():
            want = share ** mixing.POWERS[column] / whole
            assert abs(sum(r.fit for r in got if r[column] == value) / want - 1) <= mixing.TOLERANCE
    assert not [w for w in recwarn if "raking" in str(w.message)]


def test_targets_that_no_masses_meet_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "1", 90), ("b", "y", "1", 10)], "source string, lang string, topic string, mass long")
    with pytest.warns(RuntimeWarning, match="off its target"):
        assert mixing.rake(cells).count() == 2


def test_sample_meets_the_budget(spark):
    docs, vectors = table(spark, SF, "documents"), table(spark, SF, "embeddings")
    rows = mixing.mix(docs, vectors, budget=0.6).collect()
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.chance for r in rows) / total - 0.6) < 0.01
    assert abs(sum(r.n_tokens for r in rows if r.keep) / total - 0.6) < 0.1
    for r in rows:
        assert r.keep == (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < r.chance)
    assert {r.doc_id for r in mixing.sample(docs, vectors, budget=0.6).collect()} == {r.doc_id for r in rows if r.keep}


def test_mixing_awkward_rows(spark):
    vectors = spark.createDataFrame([(4, [1.0], 2), (4, [1.0], 1), (5, [1.0], None), (None, [1.0], 3)], VECTORS)
    rows = mixing.mix(awkward(spark), vectors).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and got[4].topic == "1" and got[5].topic == got[6].topic == "none"
    assert (got[2].source, got[2].lang, got[3].source) == ("none", "none", "none")
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[1].chance <= 1
    kept = mixing.sample(awkward(spark), vectors)
    assert kept.schema == awkward(spark).schema
    assert mixing.mix(empty(spark), vectors).count() == 0 and mixing.sample(empty(spark), vectors).count() == 0


PAGES = "page_id long, url string, html string, rule string, trust double"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", 1.0) for i, u, h in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    urls = {1: ("https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"), 2: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
            3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), 4: ("x://com/de/", "com", "/de/", "com/de/", "block"), 5: ("http://a.com/fr/b", "a.com", "/fr/b", "com/fr/", "allow"),
            6: ("http://acom.net/de/", "acom.net", "/de/", None, "allow"), 7: (None, "", "", None, "allow"), 8: ("example.org/es/", "", "", None, "allow"), 9: ("http://x.org", "x.org", "", None, "allow"),
            10: ("http://x.org?q=/a", "x.org", "", None, "allow"), 11: ("", "", "", None, "allow"), 12: ("a://b.org://c/d", "b.org:", "//c/d", None, "allow")}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge(pages(spark, [(i, v[0], None) for i, v in urls.items()])).collect()}
    assert got == {i: v[1:] for i, v in urls.items()}
    assert url_trust.judge(pages(spark, [])).count() == 0


def linked():
    link = lambda *hosts: " ".join(f'<a href="http://{h}/p">x</a>' for h in hosts)
    return [(1, "http://good.org/a", link("friend.net", "friend.net", "good.org")), (2, "http://bad.com/de/a", link("victim.net")),
            (3, "http://spam.net/", link("bad.com", "bad.com")), (4, "http://friend.net/", link("far.net", "spam.net")), (5, "http://far.net/", ""),
            (6, "http://victim.net/", None), (7, "http://spam.net/2", link("BAD.com")), (7, "http://spam.net/2", link("BAD.com")), (8, "http://alone.net/", "<a HREF = '//good.org/x'>"), (9, None, link("bad.com"))]


def brute_masses(rows, seeds, against):
    import re

    edges = {}
    for _, url, html in rows:
        src = url.split("://")[1].split("/")[0].lower() if url else ""
        for dst in re.findall(r"(?i)href\s*=\s*[\"']?(?:http:)?//([^/\"']+)", html or ""):
            dst = dst.lower()
            if src and src != dst:
                pair = (dst, src) if against else (src, dst)
                edges[pair] = edges.get(pair, 0) + 1
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    mass = dict(seeds)
    for _ in range(url_trust.ROUNDS):
        then = {h: m * 0.15 for h, m in seeds.items()}
        for (a, b), n in edges.items():
            then[b] = then.get(b, 0) + 0.85 * mass.get(a, 0) * n / out[a]
        mass = then
    return {h: m - 0.15 * seeds.get(h, 0) for h, m in mass.items()}


def test_trust_spreads_along_and_distrust_against_links(spark):
    rows = linked()
    got = {r.host: r for r in url_trust.judge(pages(spark, rows)).collect()}
    trust, distrust = brute_masses(rows, {"good.org": 1.0}, False), brute_masses(rows, {"bad.com": 1.0}, True)
    for host, r in got.items():
        assert abs(r.trust - trust.get(host, 0)) < 1e-8 and abs(r.distrust - distrust.get(host, 0)) < 1e-8
    assert got["spam.net"].verdict == "block" and got["victim.net"].verdict == "allow"
    for host in ("friend.net", "alone.net", "far.net", "victim.net", "spam.net"):
        worse = distrust.get(host, 0) > trust.get(host, 0) + url_trust.THRESHOLD
        assert got[host].verdict == ("block" if worse else "allow")


def test_the_sql_spreads_alike(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", linked())
    want = sorted(con.execute(url_trust.judge_sql()).fetchall(), key=str)
    assert sorted(map(tuple, url_trust.judge(pages(spark, linked())).collect()), key=str) == want


@pytest.mark.parametrize("hosts", [10, 2_000, 20_000])
def test_verdicts_do_not_depend_on_the_number_of_blocked_hosts(spark, hosts):
    link = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [(k, f"http://b{k}.com/de/", None) for k in range(hosts)] + [(hosts + k, "http://hot.com/de/", None) for k in range(hosts // 2)]
    rows += [(-1, "http://suspect.net/", link("b0.com")), (-2, "http://good.org/", link("friend.net")), (-3, "http://friend.net/", "")]
    got = {r.host: r for r in url_trust.judge(pages(spark, rows)).where("page_id < 0").collect()}
    assert got["suspect.net"].verdict == "block" and got["friend.net"].verdict == "allow"
    assert abs(got["suspect.net"].distrust - 0.1275 / len(rows[:-3])) < 1e-9


def test_distrust_reaches_the_end_of_a_chain(spark):
    rows = [(0, "http://bad.com/de/", None), *[(k, f"http://h{k}.net/", f'<a href="http://{"bad.com" if k == 1 else f"h{k - 1}.net"}/">x</a>') for k in range(1, 31)]]
    got = {r.page_id: r for r in url_trust.judge(pages(spark, rows)).collect()}
    for k in range(1, 31):
        assert got[k].verdict == "block" and abs(got[k].distrust - 0.15 * 0.85 ** k) < 1e-9


def test_masses_converge_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    got = {r.host: r.mass for r in url_trust.spread(edges, spark.createDataFrame([("a", 1.0)], "host string, mass double"), 0.85, 0.01).collect()}
    want = 0.15 * 0.85 / (1 - 0.85 ** 2)
    assert want - 0.01 <= got["b"] <= want and 0.85 * want - 0.01 <= got["a"] <= 0.85 * want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_id_output"]
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert all(0.5 * a < b < a for a, b in zip(counts, counts[1:]))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_bear_awkward_documents(spark, stage):
    for docs in (awkward(spark), empty(spark)):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()


def test_documents_helper(spark):
    assert documents(spark, [(1, None, None, None)]).count() == 1
