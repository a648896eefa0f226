from __future__ import annotations

from shelfmark.llm import urltree as U

SCHEMA = "page_id long, url string, html string, host string, template int"


def slow_rule(host, path):
    best = None
    for said, rule in U.RULES:
        site, _, rest = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return best


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


URLS = [None, "", "no scheme", "http://", "HTTP://Sub.Example.COM/en/7x?q", "https://example.com/en/8", "x://net/de/1", "http://a.net/de", "http://example.net/de/81#f", "http://org/es/", "http://notorg/es/", "http://É.ORG/es/1", "http://h?x=http://y/z", "http://h#a", "http://com/en/7", "http://example.com.evil.net/de/1", "http://h/a//b///c/", "http://h/1/2/3/4/5/6/7/8/9/10/11", "http://h/\nx", "a://b://c/d"]


def test_parts_and_rules_on_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(URLS)] + [(0, None, "h", "x", 1)], SCHEMA)
    got = U.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = slow_parts(URLS[r.id])
        want = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want[1] if want else None)
        assert r.verdict in ("allow", "block") and (want is None or r.verdict == want[0])


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h/shop/{'ab'[i % 2]}/{i}.html", "h", "x", 1) for i in range(60)]
    got = {r.template for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"/shop/+/*"}


def test_templates_of_blocked_pages_are_rejected_and_others_not(spark):
    # Under one host of org, pages below /es/ are blocked by rule; no rule speaks of those below /e2/, of which none is labelled.
    rows = [(i, f"http://h.org/es/{i}", "h", "x", 1) for i in range(40)] + [(100 + i, f"http://h.org/e2/{i}", "h", "x", 1) for i in range(10)] + [(200 + i, f"http://g.org/fr/{i}", "h", "x", 1) for i in range(40)]
    got = {r.id: r for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100].rule is None and got[100].verdict == "allow" and got[100].template == "/e2/+" and got[1].template == "/es/*"
    assert got[200].verdict == "allow" and got[1].verdict == "block"


def test_pages_that_no_rule_names_are_not_blocked_by_anothers_branch(spark):
    rows = spark.createDataFrame([(i, f"https://s.com/{lang}/{lang}-{i}", "h", "x", 1) for i in range(90) for lang in ("en", "fr", "de")], SCHEMA)
    got = U.judge(rows).groupBy("rule", "verdict").count().collect()
    assert {tuple(r) for r in got} == {("com/en/", "block", 90), (None, "allow", 180)}


def test_segments_below_the_eighth_are_judged(spark):
    # Below eight equal segments one branch is blocked by rule; the other is allowed by rule in part.
    top = "h.example/1/2/3/4/5/6/7/8"
    rules = (("block", f"{top}/bad/"), ("allow", f"{top}/good/1"))
    rows = [(i, f"http://{top}/bad/{i}", "h", "x", 1) for i in range(100, 160)] + [(i, f"http://{top}/good/{i}", "h", "x", 1) for i in (*range(10, 20), *range(20, 30))]
    got = {r.id: r for r in U.judge(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()}
    assert len(got) == 80 and all(got[i].verdict == "block" for i in range(100, 160))
    assert got[25].rule is None and got[25].verdict == "allow" and got[25].template == "/1/2/3/4/5/6/7/8/good/*"


def test_a_deep_path_alone_keeps_all_its_segments(spark):
    deep = "/".join(map(str, range(3000)))
    rows = [(1, f"http://h/{deep}", "h", "x", 1), (2, "http://h/", "h", "x", 1), (3, "http://g/a/b/c/d/e/f/g/h/i//j", "h", "x", 1)]
    got = {r.id: r.template for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == "/" and got[1] == f"/{deep}" and got[3] == "/a/b/c/d/e/f/g/h/i/j"


def test_branches_of_another_shape_stay_apart(spark):
    rows = [(i, f"http://h.example.com/en/7{i}", "h", "x", 1) for i in range(40)] + [(100 + i, f"http://h.example.com/en/8{i}", "h", "x", 1) for i in range(40)] + [(300 + i, f"http://b.net/de/{i}", "h", "x", 1) for i in range(30)] + [(400 + i, "http://b.net/xx", "h", "x", 1) for i in range(30)]
    got = {r.id: r.template for r in U.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[300] == "/de/*" and got[400] == "/xx"


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_native_operations(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "h", "x", 1)], SCHEMA)
    plan = U.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_templates(paths):
    """Level by level over plain dictionaries; ``paths``: (host, segments) -> (n, allowed, blocked)."""
    import math
    from collections import defaultdict

    def differ(a, n, b, m):
        if not n or not m:
            return False
        pooled, gap = (a + b) / (n + m), abs(a / n - b / m)
        return gap > U.APART and gap > U.Z * math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))

    done, at = {}, {k: ("", k[1]) for k in paths}
    while at:
        nodes = defaultdict(lambda: defaultdict(list))
        for key, (name, left) in at.items():
            if left:
                nodes[key[0], name][left[0]].append(key)
            else:
                done[key] = name or "/"
        then = {}
        for (host, name), kids in nodes.items():
            total = {s: [sum(paths[k][i] for k in ks) for i in range(3)] + [sum(paths[k][0] for k in ks if len(at[k][1]) == 1), len(ks)] for s, ks in kids.items()}
            n, a, b, e, p = (sum(t[i] for t in total.values()) for i in range(5))
            for s, ks in kids.items():
                own = total[s]
                o = [n - own[0], a - own[1], b - own[2], e - own[3]]
                if len(kids) >= U.VARIABLE_FROM and len(kids) >= U.VARIABLE_SHARE * p and own[0] < U.FREQUENT * n:
                    label = "*"
                elif o[0] > 0 and (own[1] + own[2] > 0) == (o[1] + o[2] > 0) and not differ(own[2], own[1] + own[2], o[2], o[1] + o[2]) and not differ(own[3], own[0], o[3], o[0]):
                    label = "+"
                else:
                    label = s
                for k in ks:
                    then[k] = (f"{name}/{'/'.join(at[k][1])}", ()) if p == 1 else (f"{name}/{label}", at[k][1][1:])
        at = then
    return done


def test_templates_purity_and_verdicts_are_those_of_plain_python(spark):
    import random
    from collections import defaultdict

    rnd = random.Random(8)
    words = ["en", "es", "de", "shop", "*", "+", "\\+", "about"]
    urls = []
    for _ in range(600):
        host = rnd.choice(["a.com", "b.org", "example.com", "c.net"])
        path = "/".join([rnd.choice(words[:4])] + [rnd.choice([rnd.choice(words), str(rnd.randrange(60))]) for _ in range(rnd.randrange(4))])
        urls.append(f"https://{host}/{path}")
    rows = {r.id: r for r in U.judge(spark.createDataFrame([(i, u, "h", "x", 1) for i, u in enumerate(urls)], SCHEMA)).collect()}
    paths = defaultdict(lambda: [0, 0, 0])
    keys = []
    for u in urls:
        host, path = slow_parts(u)
        parts = tuple("\\" + s if s.lstrip("\\") in ("*", "+") else s for s in path.split("/") if s)
        said = slow_rule(host, path)
        keys.append(((host, parts), said))
        paths[host, parts][0] += 1
        if said:
            paths[host, parts][1 if said[0] == "allow" else 2] += 1
    want = slow_templates(paths)
    sums = defaultdict(lambda: [0, 0, 0])
    for key, counts in paths.items():
        for i in range(3):
            sums[key[0], want[key]][i] += counts[i]
    for i, (key, said) in enumerate(keys):
        n, a, b = sums[key[0], want[key]]
        bad = (b + U.PRIOR / 2) / (a + b + U.PRIOR) >= U.REJECT_AT and a + b >= U.LABELLED_SHARE * n
        assert rows[i].template == want[key]
        assert rows[i].verdict == (said[0] if said else "block" if bad else "allow")


def test_shares_of_large_templates_change_nothing(spark, monkeypatch):
    rows = [(i, f"http://s.com/{'en' if i % 3 else 'fr'}/{i}/x{i % 4}", "h", "x", 1) for i in range(300)] + [(i, f"http://t.org/{i % 5}/{i}", "h", "x", 1) for i in range(300, 360)]
    pages = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, U.judge(pages).collect()))
    monkeypatch.setattr(U, "PATHS_TOGETHER", 7)
    assert sorted(map(tuple, U.judge(pages).collect())) == whole and len(whole) == 360
