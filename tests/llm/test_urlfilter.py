from almanack.llm import urlfilter
from almanack.llm.queries import URL_RULES

SCHEMA = "page_id bigint, url string, html string, host string, verdict int"


def judged(spark, rows, **more):
    out = urlfilter.judged(spark.createDataFrame([(*x, "h", 1) for x in rows], SCHEMA), URL_RULES, **more).collect()
    return {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in out}, out


def test_rules(spark):
    got, _ = judged(spark, [(1, "HTTP://WWW.Example.com/en/x?q#f", ""), (2, "https://a.example.com/en/", None), (3, "https://a.com/de", ""), (4, "https://x.net/es/1", ""), (5, None, None), (6, "no scheme", ""), (7, "https://badcom/x", ""), (8, "https://É.com?x", "")])
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow") and got[4][2:] == ("net/es/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2:] == (None, "allow")
    assert got[8] == ("É.com", "", None, "allow")


def plain(edges, seeds, rounds=20, d=0.85):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    total = sum(seeds.values())
    base = {h: (1 - d) * n / total for h, n in seeds.items()}
    now = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for a, targets in out.items():
            for b in targets:
                new[b] = new.get(b, 0) + d * now.get(a, 0) / len(targets)
        now = new
    return now


def test_propagation_against_plain_rounds(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/p">x</a>' for h in hs) + '<a href="/own">y</a>'
    rows = [(1, "https://good.com/x", link("mid.org", "far.org")), (2, "https://mid.org/x", link("far.org")), (3, "https://far.org/x", link("bad.net")), (4, "https://bad.net/fr/x", link("mid.org")), (5, "https://spam.org/x", link("bad.net", "bad.net")), (6, "https://lone.org/", ""), (6, "https://lone.org/", "")]
    got, out = judged(spark, rows)
    edges = [("good.com", "mid.org"), ("good.com", "far.org"), ("mid.org", "far.org"), ("far.org", "bad.net"), ("bad.net", "mid.org"), ("spam.org", "bad.net"), ("spam.org", "bad.net")]
    t, q = plain(edges, {"good.com": 1}), plain([(b, a) for a, b in edges], {"bad.net": 1})
    for page, host in ((2, "mid.org"), (3, "far.org"), (5, "spam.org"), (6, "lone.org")):
        assert got[page][3] == ("block" if q.get(host, 0) > t.get(host, 0) else "allow"), host
    assert len(out) == 7 and got[5][3] == "block"
    again, _ = judged(spark, rows, broadcast_rows=0)
    assert again == got


def test_which_links_count(spark):
    bad = (9, "https://bad.net/fr/x", "")
    html = {"plain": "<a href=https://bad.net/>", "plain, no end": "<a href=//bad.net", "upper": "<A HREF = 'HTTPS://BAD.NET/x y'>", "long": "x " * 300_000 + '<a\nhref="https://bad.net/">', "after a script": '<script>s="</a>"</script><a class=c href=https://bad.net>'}
    none = {"comment": '<!-- <a href="https://bad.net/"> -->', "open comment": '<!-- <a href="https://bad.net/">', "script": '<script>s=\'<a href="https://bad.net/">\'</script>', "other attribute": '<a data-href="https://bad.net/">', "own": '<a href="/x">', "null": None}
    rows = [(i, f"https://h{i}.org/", x) for i, x in enumerate([*html.values(), *none.values()], 10)]
    got, _ = judged(spark, [bad, *rows])
    assert {k: got[i][3] for i, k in enumerate([*html, *none], 10)} == dict.fromkeys(html, "block") | dict.fromkeys(none, "allow")


def test_empty(spark):
    assert judged(spark, [])[1] == []


def test_a_chain_of_more_than_20_hosts(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(22)], "src string, dst string, w double")
    got = {x.host: x.s for x in urlfilter.propagated(spark.createDataFrame([("h0", 1.0)], "host string, s double"), edges, damping=0.85, close=1e-9).collect()}
    assert len(got) == 23 and all(abs(got[f"h{i}"] - 0.15 * 0.85**i) < 1e-12 for i in range(23))
