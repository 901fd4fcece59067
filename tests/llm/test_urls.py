"""URL filters against plain Python."""

import random
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tessella.llm import urls
from tessella.llm.queries import QUERIES, REVISIONS

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
RANK = {"block": 2, "allow": 1, None: 0}


def parts(url):
    rest = re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "", url.strip(" "))
    name = re.match(r"[^/?#]*", rest)[0]
    path = re.sub(r"[?#].*", "", rest[len(name) :], flags=re.S)
    name = re.sub(r":[0-9]*$", "", name.rpartition("@")[2])
    return (name[:-1] if name.endswith(".") else name).lower(), re.sub("/$", "", re.sub("/+", "/", path))


def brute(url, at, revisions):
    """Each entry's last revision at or before the time, over every entry of the list."""
    if url is None or at is None:
        return None
    name, path = parts(url)
    last = {}
    for entry, since, verdict in revisions:
        if entry is None or since is None:
            continue
        h, p = parts(re.sub(r"^\*?\.", "", entry.strip(" ")))
        covers = h and (name == h or (name.endswith("." + h) and not re.fullmatch(r"[0-9.]+", name))) and (path == p or path.startswith(p + "/"))
        if covers and since <= at:
            last[h, p] = max(last.get((h, p), (since, -1, "")), (since, RANK[verdict], entry, verdict), key=lambda r: r[:3])
    able = [(len(h), len(p), r) for (h, p), r in last.items() if r[3] is not None]
    return max(able)[2] if able else None


def test_judge(spark):
    random.seed(11)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "a.co", "1.2.3.4", "2.3.4", "A.Com."]
    paths = ["", "/", "/p", "/p/q", "/p//q/", "/pq", "/P", "/p/q/r.html"]
    hour = lambda: START + timedelta(hours=random.randrange(12))
    made = [(i, random.choice(["http://", "https://u:p@", "//", "", "HTTP://"]) + random.choice(hosts) + random.choice(["", ":80"]) + random.choice(paths) + random.choice(["", "?x=/p", "#t", "/?a@b"]), hour()) for i in range(600)]
    made += [made[0], (900, None, START), (901, "http://a.com/", None), (902, "", START), (903, "http:///p", START), (904, "a.com" + "/p" * 300, START + timedelta(hours=20))]
    # entry and time stand for one revision each, so that what decides is told apart
    log = {(random.choice(["", ".", "*.", "http://"]) + random.choice(hosts) + random.choice(paths), hour()): random.choice(["block", "allow", None]) for _ in range(60)}
    log = [(e, s, v) for (e, s), v in log.items()] + [(None, START, "block"), ("a.com", None, "block"), ("/p", START, "block")]
    rows = spark.createDataFrame(made, "id long, url string, at timestamp").withColumns({"host": F.lit("h"), "rule_": F.lit(1), "history": F.lit("x")})
    found = urls.judge(rows, spark.createDataFrame(log, "entry string, since timestamp, verdict string"))
    assert found.columns == [*rows.columns, "rule"]
    got = sorted(repr((r.id, r.rule and r.rule.verdict, r.rule and r.rule.since)) for r in found.withColumn("rule", F.when(F.col("rule").isNotNull(), F.struct("rule.verdict", F.unix_seconds("rule.since").alias("since")))).collect())
    want = [(i, brute(u, t, log)) for i, u, t in made]
    assert got == sorted(repr((i, w and w[3], w and int(w[0].timestamp()))) for i, w in want)
    assert len({w and w[3] for _, w in want}) == 3
    assert urls.judge(rows, spark.createDataFrame([], "entry string, since timestamp, verdict string")).where("rule is not null").count() == 0
    assert urls.judge(rows.limit(0), spark.createDataFrame(log, "entry string, since timestamp, verdict string")).count() == 0


def test_query_judges_every_page(spark, sf_dir):
    log = [(e, datetime.fromisoformat(s + "+00:00"), v) for e, s, v in REVISIONS]
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    want = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        at = START + timedelta(seconds=r.page_id * 104_729 % (30 * 86_400))
        w = brute(r.url, at, log)
        want.append((r.page_id, parts(r.url)[0], int(at.timestamp()), w and w[2], w and int(w[0].timestamp()), w and w[3], not (w and w[3] == "block")))
    found = [tuple(r) for r in QUERIES["op1_url_filters"](spark, sf_dir).collect()]
    assert sorted(found) == sorted(want) and {r[5] for r in want} >= {"block", None}
