import re
from collections import Counter, defaultdict

from scorecraft.llm import url_filter
from scorecraft.llm.url_filter import DAMPING, RATIO, RULES

#: Coarser than the operator's own, so that waves fade out sooner.
UNIT = 1 << 10

SCHEMA = "page_id long, url string, html string, host string, mass long"


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)


PAGES = [
    (1, "http://good.org/a", link("Friend.net", "friend.net", "far.net")), (2, "https://friend.net/", link("far.net") + '<a href="/own">'),
    (3, "http://far.net/p?q#f", link("bad.example.org")), (4, "http://bad.example.org/es/1", "<a href='//farm.net/'>"),
    (5, "http://farm.net/x", link("bad.example.org", "pills.net")), (6, "http://pills.net/", link("farm.net")),
    (7, "http://a.example.org/en/12", ""), (8, "http://a.example.org/en/2", None), (9, "http://shop.com/fr/1", ""),
    (10, "http://shop.com/de/1", ""), (11, "http://shop.com/en/1", ""), (12, None, link("farm.net")), (13, "no scheme", ""),
    (14, "HTTP://UPPER.ORG", ""), (15, "x://y://z/path", ""), (16, "http://org", ""), (17, "http://org/", ""), (18, "http://notorg/", ""),
    (18, "http://notorg/", ""), (None, "http://lonely.net/" + "p" * 50_000, "x" * 100_000), (19, "", ""), (20, "http://?q", ""),
]


def brute(pages):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    split = lambda url: (re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "") or re.match("()()", "")).groups()
    links, share, judged = Counter(), defaultdict(lambda: [0, 0, 0]), []
    for i, url, html in pages:
        host, path = split(url)
        host = lower(host)
        rule = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        judged.append((i, host, path, rule[1], rule[2]))
        if host:
            share[host][0] += 1
            share[host][1] += rule[2] == "allow"
            share[host][2] += rule[2] == "block"
            for to in {m for m in re.findall(url_filter.LINK, html or "")}:
                if to and lower(to) != host:
                    links[host, lower(to)] += 1
    mass = {}
    for kind, arcs in (("T", links), ("D", {(b, a): w for (a, b), w in links.items()})):
        out = Counter()
        for (a, _), w in arcs.items():
            out[a] += w
        wave = {h: s["TD".index(kind) + 1] * UNIT // s[0] * (DAMPING[1] - DAMPING[0]) // DAMPING[1] for h, s in share.items()}
        total = Counter(wave)
        while any(wave.values()):
            new = Counter()
            for (a, b), w in arcs.items():
                new[b] += wave.get(a, 0) * w // out[a] * DAMPING[0] // DAMPING[1]
            wave = new
            total.update(wave)
        mass[kind] = total
    return Counter(
        (i, h, p, r, v or ("block" if mass["D"][h] > RATIO * mass["T"][h] else "allow")) for i, h, p, r, v in judged
    )


def test_rules_and_propagation_against_brute_force(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], SCHEMA)
    rows = url_filter.judge(pages, unit=UNIT).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == brute(PAGES)
    verdict = {r["host"]: r["verdict"] for r in rows if r["rule"] is None}
    assert verdict["friend.net"] == "allow" and verdict[""] == "allow"


def test_named_seeds_and_empty_table(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], SCHEMA)
    rows = url_filter.judge(pages, rules=(), trusted=["farm.net"], blocked=["far.net"], unit=UNIT).collect()
    verdict = {r["host"]: r["verdict"] for r in rows}
    assert verdict["far.net"] == "block" and verdict["friend.net"] == "block" and verdict["farm.net"] == "allow"
    assert {r["rule"] for r in rows} == {None}
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_chain_is_followed_to_its_end(spark):
    chain = [(i, f"http://h{i}.net/", link(f"h{i - 1}.net") if i else "") for i in range(31)]
    pages = spark.createDataFrame(chain, "page_id long, url string, html string")
    verdicts = lambda **kw: {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), blocked=["h0.net"], **kw).collect()}
    assert set(verdicts().values()) == {"block"}
    assert {i for i, v in verdicts(steps=5).items() if v == "block"} == set(range(6))


def test_sql_follows_the_waves_too(spark, scratch):
    """The query and its SQL on pages that link in chains and cycles."""
    import duckdb

    from scorecraft.llm.oracle import SQL

    ring = [(100 + i, f"http://ring{i}.org/en/", link(f"ring{(i + 1) % 3}.org", "friend.net")) for i in range(3)]
    path = scratch(spark.createDataFrame([(i, u, h) for i, u, h in PAGES + ring], "page_id long, url string, html string"), 1)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    sql = SQL["op6_url_filter"].replace(str(url_filter.UNIT), str(UNIT))
    rows = url_filter.judge(spark.read.parquet(path), unit=UNIT).drop("trust", "distrust").collect()
    assert Counter(map(tuple, rows)) == Counter(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({sql})").fetchall())
