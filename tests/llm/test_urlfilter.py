import random
import re

from glossgraph.llm import urlfilter
from glossgraph.llm.queries import RULES, op1_url_filter


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


def test_query_parses_and_rules_like_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op1_url_filter(spark, folder).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


URLS = [None, "", "nothing", "http://", "x://Ä.ExAmple.NET/en/a?b#c", "x://net", "x://net/", "x://a.org#/fr/", "x://a.org/fr/x", "x://aorg/fr/", "http://a://b.net/c", "x://example.com/de/1", "x://EXAMPLE.com/den", "x://" + "h" * 5000 + "/" + "p/" * 5000]


def test_odd_addresses_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(URLS)] + [(1, "", None, "clash")], "page_id long, url string, bad int, host string")
    rows = urlfilter.judge(df, RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule) == brute(URLS[r.page_id])[:3]
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_bad_branches_are_rejected_and_variable_ones_merged(spark):
    rows = []
    for k in range(300):
        rows.append((f"http://h.org/spam/item{k}-x{'abcdefghij'[k % 10]}{k}.html", 1 if k % 10 else None))
        rows.append((f"http://h.org/news/{2000 + k % 20}/{k}", 0 if k % 10 else None))
        rows.append((f"http://h.org/user/{'abcdefghij'[k % 10] * (1 + k // 10)}/profile", k % 2))
    df = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    judged = urlfilter.judge(df, ()).collect()
    by = {}
    for r in judged:
        by.setdefault(rows[r.page_id][0].split("/")[3], []).append(r)
    assert all(r.verdict == "block" and r.template.startswith("/spam/") for r in by["spam"])
    assert all(r.verdict == "allow" for r in by["news"]) and {r.template for r in by["news"]} == {"/news/{n}/{n}"}
    assert {r.template for r in by["user"]} == {"/user/*/profile"}


def test_stars_and_braces_in_addresses_are_no_wildcards(spark):
    rows = [(k, f"http://h.org/{('*', '{n}', str(k))[k % 3]}/x", int(k % 3 < 2)) for k in range(300)]
    judged = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), ()).collect()
    found = {}
    for r in judged:
        found.setdefault(r.page_id % 3, set()).add(r.verdict)
    assert found == {0: {"block"}, 1: {"block"}, 2: {"allow"}}
    assert {r.template for r in judged if r.page_id % 3 == 2} == {"/{n}/x"}


def test_thousands_of_rules_are_a_table(spark):
    rules = tuple(urlfilter.Rule(("allow", "block")[k % 2], f"{'abc'[k % 3]}{k // 9}.org/{'x' * (k % 5)}") for k in range(5000)) + (urlfilter.Rule("block", "org/"), urlfilter.Rule("allow", "/none"))
    urls = [f"http://{'w.' * (k % 3)}{'abcd'[k % 4]}{k}.org/{'x' * (k % 7)}" for k in range(600)] + ["", "x:///none/a", "x://a..org/", "x://org./", "x://" + "o." * 3000 + "org/"]
    rows = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "CAST(NULL AS INT) AS bad"), rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        fits = [(len(x.text), x.text, x.verdict) for x in rules if (r.host == x.parts[0] or r.host.endswith("." + x.parts[0])) and r.path.startswith(x.parts[1])]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow")), urls[r.page_id]


def tree(addresses):
    """Templates by the same rules in plain loops: {(host, shape): template} from {(host, shape): [n, labelled, bad]}."""
    out, state = {}, {key: ("", list(key[1])) for key in addresses}
    while state:
        groups, following = {}, {}
        for key, (template, rest) in state.items():
            groups.setdefault((key[0], template), []).append(key)
        for (_, template), keys in groups.items():
            rests = sorted((state[k][1] for k in keys), key=lambda r: [x.encode() for x in r])
            low, high = rests[0], rests[-1]
            shared = next((i for i in range(max(len(low), len(high))) if i >= min(len(low), len(high)) or low[i] != high[i]), len(low))
            grown = "/".join([template, *low[:shared]])
            for key in keys:
                rest = state[key][1][shared:]
                if not rest:
                    out[key] = grown
            keys = [k for k in keys if k not in out]
            children = {}
            for key in keys:
                sums = children.setdefault(state[key][1][shared], [0, 0, 0])
                for j in range(3):
                    sums[j] += addresses[key][j]
            whole = [sum(c[j] for c in children.values()) for j in range(3)]
            apart = {}
            for name, (_, labelled, bad) in children.items():
                p, q = (bad + 1) / (labelled + 2), (whole[2] - bad + 1) / (whole[1] - labelled + 2)
                error = (p * (1 - p) / (labelled + 2) + q * (1 - q) / (whole[1] - labelled + 2)) ** 0.5
                apart[name] = abs(p - q) >= urlfilter.APART * error
            variable = len(children) >= urlfilter.MANY and whole[0] < len(children) * urlfilter.FEW_EACH
            alike = sum(not x for x in apart.values())
            for key in keys:
                name = state[key][1][shared]
                branch = urlfilter.WILD if variable or (not apart[name] and alike > 1) else name
                following[key] = (f"{grown}/{branch}", state[key][1][shared + 1 :])
        out.update({k: t for k, (t, rest) in following.items() if not rest})
        state = {k: v for k, v in following.items() if v[1]}
    return out


def test_tree_and_purity_match_plain_loops(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["news", "spam", "user", "a", "b", "*", "2020", f"n{rng.randrange(40)}x", ""])
    rows = []
    for k in range(1500):
        parts = [part() for _ in range(rng.randrange(6))]
        bad = None if rng.random() < 0.3 else int(("spam" in parts) != (rng.random() < 0.1))
        rows.append((k, f"http://{rng.choice(['h.org', 'g.org'])}/{'/'.join(parts)}", bad))
    judged = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), ()).collect()
    addresses, of = {}, {}
    for k, url, bad in rows:
        host, path = brute(url)[:2]
        shape = tuple(re.sub("[0-9]+", "{n}", path.removeprefix("/").replace("{", "{{").replace("*", "{*")).split("/"))
        of[k] = (host, shape)
        sums = addresses.setdefault((host, shape), [0, 0, 0])
        sums[0] += 1
        sums[1] += bad is not None
        sums[2] += bad or 0
    want = tree(addresses)
    template, hosts, table = {}, {}, [0, 0]
    for key, (_, labelled, bad) in addresses.items():
        for sums in (template.setdefault((key[0], want[key]), [0, 0]), hosts.setdefault(key[0], [0, 0]), table):
            sums[0] += labelled
            sums[1] += bad
    base = (table[1] + 1) / (table[0] + 2)
    for r in judged:
        assert r.template == want[of[r.page_id]], (r.url, r.template, want[of[r.page_id]])
        labelled, bad = hosts[r.host]
        above = (bad + urlfilter.STRENGTH * base) / (labelled + urlfilter.STRENGTH)
        labelled, bad = template[r.host, r.template]
        share = (bad + urlfilter.STRENGTH * above) / (labelled + urlfilter.STRENGTH)
        assert abs(r.bad_share - share) < 1e-9 and r.verdict == ("block" if r.bad_share >= urlfilter.REJECT else "allow")


def test_similar_siblings_share_a_wildcard(spark):
    rows = [(k, f"http://h.org/{'ab'[k % 2]}/x", int(k % 4 < 2)) for k in range(200)]
    judged = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), ()).collect()
    assert {r.template for r in judged} == {"/*/x"}


def test_branches_far_below_are_judged_apart(spark):
    rows = [(k, f"http://h.org/a/b/{'cd'[k // 2 % 2]}/d/e/{('spam', 'news')[k % 2]}/{k}", 1 - k % 2) for k in range(200)]
    judged = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), ()).collect()
    assert {(r.page_id % 2, r.template, r.verdict) for r in judged} == {(0, "/a/b/*/d/e/spam/{n}", "block"), (1, "/a/b/*/d/e/news/{n}", "allow")}
