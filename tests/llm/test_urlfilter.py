import random
import re

from clearlane.llm import urlfilter
from clearlane.llm.urlfilter import ALLOW, BLOCK, Rule


def fits(rule, host, path):
    if not rule.glob:
        return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
    regex = lambda text, any_: "".join(f"{any_}*" if c == "*" else any_ if c == "?" else re.escape(c) for c in text)
    return bool(re.fullmatch("(.*[.])?" + regex(rule.host, "[^/]"), host, re.S) and re.match(regex(rule.path, "(.|\\n)"), path))


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        rest = rest[k:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in rules if fits(r, host, path)]
    best = max(fit, key=lambda r: (len(r.text), r.verdict == BLOCK), default=None)
    return host, path, best.text if best else None, best.verdict if best else ALLOW


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(urlfilter.judge_urls(df, rules).collect())
    assert [tuple(r)[1:] for r in got] == [brute(u, rules) for u in urls]


def test_rules_of_production(spark):
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "org", "x.com", "com", "com.", "a.b:80", "\u00c9.org", "org.evil", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/y", "/x.org/es/", "//org/", "/%zz/\u00e9", "?q=/es/", "#/de/", "/de/" + "x" * 3000]
    urls = [f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths]
    check(spark, [*urls, None, "", "example.org/es/", "a://b://c/", "http:/x.org/", "://org/"], urlfilter.RULES)


def test_many_rules_over_several_mask_words(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    rules = list({(h := name(), p := "/" + name()): Rule(rng.choice([ALLOW, BLOCK]), h, p) for _ in range(60)}.values())
    assert urlfilter.Automaton(rules).words > 3
    urls = [f"http://{'.'.join(name() for _ in range(rng.randrange(1, 4)))}/{name()}{name()}" for _ in range(400)]
    texts = {r.text for r in rules}
    assert len(texts) == len(rules)
    check(spark, urls, rules)


def test_globs(spark):
    rules = [
        Rule(BLOCK, "ads.*", "/", True), Rule(BLOCK, "example.com", "/*/print/", True), Rule(ALLOW, "example.com", "/"),
        Rule(BLOCK, "s?.example.net", "/a?c", True), Rule(ALLOW, "*.example.net", "/*.html", True), Rule(BLOCK, "x.*.y", "/**/z", True), Rule(BLOCK, "h", "/*?"),
    ]
    hosts = ["ads.com", "www.ads.co.uk", "loads.com", "example.com", "s1.example.net", "s\u00e9.example.net", "s12.example.net", "example.net", "x.a.b.y", "x.y", "h"]
    paths = ["/", "", "/news/print/1", "/news/a/print/", "/print/", "/abc", "/a\u20acc/d", "/ac", "/a/b.html", "/b.htm", "/q/z", "/z", "/*?x", "/yx?z/print/"]
    check(spark, [f"http://{h}{p}" for h in hosts for p in paths], rules)


def test_random_globs(spark):
    rng = random.Random(9)
    name = lambda signs, n: "".join(rng.choice(signs) for _ in range(rng.randrange(1, n)))
    rules = list({(h := name("ab.*?", 5), p := "/" + name("ab/*?", 5)): Rule(rng.choice([ALLOW, BLOCK]), h, p, True) for _ in range(40)}.values())
    assert urlfilter.Automaton(rules).words > 2
    # several rules may have one text
    rules = list({r.text: r for r in rules}.values())
    check(spark, [f"http://{name('ab.', 7)}/{name('ab/', 7)}" for _ in range(400)], rules)


def test_empty_table_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge_urls(df).collect()] == [ALLOW] * 3
    assert urlfilter.judge_urls(df.limit(0)).collect() == []
