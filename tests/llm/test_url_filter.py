import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexmill.llm import url_filter as U


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule(host, path):
    fit = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def windows(url):
    t = "\x02" * 4 + (url.split("://", 1)[1] if "://" in url else url) + "\x03"
    return [t[i : i + 5] for i in range(len(t) - 4)]


def plain_scores(urls):
    urls = sorted({u for u in urls if u is not None})
    back = {u: hashlib.md5(u.encode()).hexdigest()[0] in "012" for u in urls}
    said = {u: rule(*split(u))[1] for u in urls}
    p = {}
    for what in ("allow", "block"):
        n = Counter(w[5 - k :] for u in urls if said[u] == what and not back[u] for w in windows(u) for k in range(1, 6))
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in n.items():
            total[len(g), g[:-1]] += c
            kinds[len(g), g[:-1]] += 1

        p[what] = (n, total, kinds)

    def prob(what, g):
        if not g:
            return 1 / 256
        n, total, kinds = p[what]
        lower, ctx = prob(what, g[1:]), (len(g), g[:-1])
        return (n[g] + kinds[ctx] * lower) / (total[ctx] + kinds[ctx]) if total[ctx] else lower

    score = {u: sum(math.log(prob("allow", w)) - math.log(prob("block", w)) for w in windows(u)) / len(windows(u)) for u in urls}
    return score, back, said


def urls():
    rng = random.Random(51)
    out = []
    for _ in range(400):
        host = rng.choice(["", "www.", "Blog."]) + rng.choice(["aa", "bee", "spam-farm", "pills"]) + ".example." + rng.choice(["org", "com", "net"])
        out.append(f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(300)}{rng.choice(['', '?x=1', '#top', '.html'])}")
    return out + out[:9] + [None, "", "no scheme", "http://", "http://org", "x://ORG/", "a://b://c.com/fr/", "http://notorg/", "http://example.org/en/1", "ftp://é.com/de/ß", "http://h?/de/", "://com/de/", "http://x.net/a\nb" + "y" * 3000]


def test_matches_brute_force(spark):
    rows = list(enumerate(urls()))
    score, back, said = plain_scores([u for _, u in rows])
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"w": F.lit("x"), "score": F.lit("clash"), "host": F.lit(1)}).repartition(3)
    got = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert len(got) == len(rows)
    cut = U.threshold(spark.createDataFrame([(u, said[u], back[u], round(s, 6)) for u, s in score.items()], "url string, verdict string, kept_back boolean, score double"))
    for i, u in rows:
        host, path = split(u)
        name, verdict = rule(host, path)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert abs(r["score"] - (score[u] if u is not None else 0)) < 2e-6
        assert r["verdict"] == (verdict or ("allow" if r["score"] >= cut else "block"))
    labelled = [(said[u], score[u] >= cut) for u in score if back[u] and said[u]]
    assert sum((s == "allow") == ok for s, ok in labelled) / len(labelled) > 0.85


def test_empty_and_undecided(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).count() == 0
    (r,) = U.judge(spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")).collect()
    assert (r["rule"], r["verdict"], r["score"]) == (None, "allow", 0.0)


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = U.url_scores(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Pandas" not in plan and "CartesianProduct" not in plan
