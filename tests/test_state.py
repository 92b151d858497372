"""Streams with expiring state against plain replays of the same events."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import stateful

SCHEMA = "event_id long, user_id long, event_type string, t timestamp"
START = 1_700_000_000


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def some_events(seed: int, n: int = 240, users: int = 4) -> list[tuple]:
    """Events in order of time, in bursts and with pauses."""
    rng, t, out = random.Random(seed), START, []
    for i in range(n):
        t += rng.choice((1, 2, 5, 20, 20, 90, 400) if i % 40 else (4000,))
        out.append((i, rng.randrange(users), rng.choice(("error", "error", "view", "purchase")), t))
    return out


class Stream:
    """Events fed file by file, one micro-batch each."""

    def __init__(self, spark, tmp_path, name: str):
        self.spark, self.path, self.name, self.at = spark, tmp_path, name, 0
        (tmp_path / "in").mkdir()

    def feed(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("t"))
        df.coalesce(1).write.parquet(f"{self.path}/staged{self.at}")
        for f in (self.path / f"staged{self.at}").glob("*.parquet"):
            f.rename(self.path / "in" / f"{self.at:04d}.parquet")
        self.at += 1

    def read(self):
        return self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in")

    def start(self, df):
        return df.writeStream.format("memory").queryName(self.name).option("checkpointLocation", f"{self.path}/cp").outputMode("append").start()

    def state(self, variable: str) -> list:
        return self.spark.read.format("statestore").option("stateVarName", variable).load(f"{self.path}/cp").select("key.user_id").collect()


def run(rocks, tmp_path, name, operator, rows, cuts=4):
    """The rows that an operator gives over ``rows`` in several batches, and the users of whom state is left, before and after time has passed."""
    s = Stream(rocks, tmp_path, name)
    query = s.start(operator(s.read()))
    variable = {"rate": "log", "lock": "failures", "session": "open", "idle": "last"}[name]
    try:
        size = -(-len(rows) // cuts)
        for a in range(0, len(rows), size):
            s.feed(rows[a : a + size])
            query.processAllAvailable()
        there = {r.user_id for r in s.state(variable)}
        s.feed([(10**6, 99, "view", rows[-1][3] + 10**6)])  # another user much later
        query.processAllAvailable()
        left = {r.user_id for r in s.state(variable)}
        return rocks.table(name).collect(), there, left
    finally:
        query.stop()


def by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_rate_limit(rocks, tmp_path):
    rows = some_events(1)
    got, there, left = run(rocks, tmp_path, "rate", lambda e: stateful.rate_limit(e, 3, 60), rows)
    want = {}
    for own in by_user(rows).values():
        log = []
        for i, _, _, t in own:
            log = [x for x in log if x > t - 60]
            want[i] = len(log) < 3
            if want[i]:
                log.append(t)
    assert {r.event_id: r.accepted for r in got if r.event_id < 10**6} == want and not all(want.values())
    assert there and left <= {99}


def test_lockout(rocks, tmp_path):
    rows = some_events(2)
    got, there, left = run(rocks, tmp_path, "lock", lambda e: stateful.lockout(e, 3, 300), rows)
    want, open_ = {}, set()
    for user, own in by_user(rows).items():
        n, last = 0, 0
        for i, _, kind, t in own:
            if n >= 3 and t >= last + 300:
                n = 0
            want[i] = n >= 3
            if not want[i]:
                n, last = (n + 1, t) if kind == "error" else (0, last)
        if 0 < n < 3:
            open_.add(user)
    assert {r.event_id: r.locked for r in got if r.event_id < 10**6} == want and any(want.values())
    assert left == open_  # locks have ended and successes have cleared the rest


def test_sessions_are_extended_and_expire(rocks, tmp_path):
    rows = some_events(3)
    got, there, left = run(rocks, tmp_path, "session", lambda e: stateful.expiring_sessions(e, 60), rows)
    want = []
    for user, own in by_user(rows).items():
        for i, _, _, t in own:
            if want and want[-1][0] == user and t <= want[-1][2] + 60:
                want[-1] = (user, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((user, t, t, 1))
    micro = 1_000_000
    assert sorted((r.user_id, r.first_us, r.expires_us, r.n) for r in got) == sorted((u, a * micro, (b + 60) * micro, n) for u, a, b, n in want)
    assert there and left == {99}


def test_idle_users(rocks, tmp_path):
    rows = some_events(4)
    got, there, left = run(rocks, tmp_path, "idle", lambda e: stateful.idle_users(e, 300), rows)
    last = {u: own[-1][3] for u, own in by_user(rows).items()}
    assert {(u, t * 1_000_000) for u, t in last.items()} <= {(r.user_id, r.last_us) for r in got} and left == {99}


def test_sessions_in_any_order():
    rng = random.Random(5)
    times = [rng.randrange(3000) for _ in range(200)]
    whole = stateful.extended([], sorted(times), 20)
    parts = []
    for a in range(0, 200, 7):
        parts = stateful.extended(parts, times[a : a + 7], 20)
    assert parts == whole and sum(n for _, _, n in whole) == 200


def test_followed_events(spark, tmp_path):
    """The stream gives the rows of the plain join, counts what comes too late, and keeps no state of what is over."""
    rows = some_events(6)
    s = Stream(spark, tmp_path, "followed")
    side = lambda e, kind: e.filter(F.col("event_type") == kind)
    joined = stateful.followed(side(s.read(), "view"), side(s.read(), "purchase"), "90 seconds", "0 seconds")
    query = s.start(joined)
    try:
        for a in range(0, 240, 60):
            s.feed(rows[a : a + 60])
            query.processAllAvailable()
        assert stateful.dropped_rows(query) == 0
        s.feed([(10**6, 98, "view", START + 10**7), (10**6 + 1, 98, "purchase", START + 10**7)])
        query.processAllAvailable()
        s.feed([(7, 1, "view", START)])
        query.processAllAvailable()
        assert stateful.dropped_rows(query) == 1
        got = sorted((r.first_id, r.second_id or -1) for r in spark.table("followed").collect() if r.first_id < 10**6)
        kept = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        query.stop()
    plain = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("t", F.timestamp_seconds("s"))
    batch = stateful.followed(side(plain, "view"), side(plain, "purchase"), "90 seconds")
    assert got == sorted((r.first_id, r.second_id or -1) for r in batch.collect()) and kept <= 2
    want = sorted((i, next((j for j, v, k, z in rows if v == u and k == "purchase" and t < z <= t + 90), -1)) for i, u, kind, t in rows if kind == "view")
    assert {i for i, _ in got} == {i for i, _ in want} and {i for i, j in got if j < 0} == {i for i, j in want if j < 0}


def test_limits():
    assert stateful.allowed([0, 1, 2, 61], [], 2, 60) == ([True, True, False, True], [61])
    assert stateful.locked([(i, True) for i in range(7)] + [(400, False)], 0, 0, 5, 300)[0] == [False] * 5 + [True] * 2 + [False]
