import datetime
import random
import time

from sheafline.streaming import detector, events, ordered


def plain_cycle(keys, single=10, several=3):
    best = (0, 0)
    for p in range(1, 6):
        run = 0
        for i in range(p, len(keys) + 1):
            if i < len(keys) and keys[i][0] and keys[i] == keys[i - p]:
                run += 1
                continue
            repeats, seed = run // p + 1, keys[i - run - p : i - run]
            if run and repeats >= (single if p == 1 else several) and repeats > best[1] and (p == 1 or any(s != seed[0] for s in seed)):
                best = (p, repeats)
            run = 0
    return best


def test_cycles_match_a_plain_scan():
    rng = random.Random(4)
    for _ in range(2000):
        keys = [(rng.choice(["a", "b", "c", ""]), "") for _ in range(rng.randrange(0, 40))]
        got = detector.cycle(keys, single=4, several=2)
        assert (got[:2] if got else (0, 0)) == plain_cycle(keys, 4, 2)


def test_signs_of_a_loop():
    assert detector.loop_in("aaaaaa").startswith("char_run") and detector.loop_in("abcabcabcabc").startswith("ngram_loop")
    assert detector.loop_in("0000000000 null,null,null,null, lalalala") is None
    items = "".join(f'{{"n":"{"AB"[k % 2]}","t":{k % 2}}},' for k in range(6))
    assert detector.loop_in(items).startswith("cyclic_items period=2 repeats=3")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, k, ("x" * 3 + str(k) + " ") * 20 if r != "loop" else "Ab1 " * 30, None) for r in ("calm", "loop", "short") for k in range(12 if r != "short" else 1)]
    rows += [("brief", 0, "ok ababababab", "stop"), ("late", 0, "calm words " * 48, None), ("late", 1, "zzzzzzzz", "stop"), ("none", 0, None, "stop")]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "ref string, seq long, delta string, finish_reason string")
    df.coalesce(1).write.parquet(src)
    batch = sorted(map(tuple, detector.check_batch(df).collect()))
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = detector.check_stream(stream, timeout_ms=None).writeStream.format("memory").queryName("loops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("loops").collect())) == batch and {r[0] for r in batch} == {"brief", "late", "loop"}


def test_a_loop_at_the_start_of_a_very_long_turn_is_seen(spark):
    calm = " ".join(f"{k}x" for k in range(17_000))[:100_000]
    items = "".join(f'{{"n":"{"AB"[k % 2]}","t":{k % 2}}},' for k in range(12))
    rows = [("calm", 0, calm), ("run", 0, "aaaaaaaa " + calm), ("ngram", 0, "abcabcabcabcabc " + calm), ("items", 0, items + calm)]
    df = spark.createDataFrame(rows, "ref string, seq long, delta string")
    got = {r.ref: r.reason.split()[0] for r in detector.check_batch(df).collect()}
    assert got == {"run": "char_run", "ngram": "ngram_loop", "items": "cyclic_items"}


# ---- state by key ----

def run_stream(spark, tmp_path, df, build, name, files=6):
    src = str(tmp_path / name)
    df.repartition(files).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name), q


def test_shuffled_deltas_over_several_batches_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for r in range(12):
        calm = [f"{rng.random()} word{rng.random()} " * 8 for _ in range(9)]
        if r % 3 == 1:
            calm[rng.randrange(9)] += "abcabcabcabcabc"
        if r % 3 == 2:
            calm[4:7] = ["".join(f'{{"n":"{"AB"[k % 2]}","t":{k % 2}}},' for k in range(j * 14, j * 14 + 14)) for j in range(3)]
        rows += [(f"r{r}", k, t, "stop" if k == 8 else None) for k, t in enumerate(calm)]
    rows += [("empty", 0, None, "stop"), ("one", 0, "zzzzzzzzz", "stop")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ref string, seq long, delta string, finish_reason string")
    got, q = run_stream(spark, tmp_path, df, lambda s: ordered.check_ordered(s, every=100, tail=5000, timeout_ms=None), "ordered")
    want = sorted(map(tuple, detector.check_batch(df, every=100, tail=5000).collect()))
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {"one", *(f"r{k}" for k in range(12) if k % 3)}
    assert q.lastProgress["batchId"] >= 3
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 0  # every text ended


def test_repeated_requests_are_dropped_and_their_state_goes(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    rows = [(f"k{k % 40}", at(k // 40 * 2 + k % 40 * 30)) for k in range(200)]  # five of each within eight minutes
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    src = tmp_path / "src"
    for k in range(4):  # in the order of time, ten keys a file
        df.where(f"CAST(substring(key, 2) AS INT) DIV 10 = {k}").coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = events.first_requests(stream, "key", "ts", "20 minutes").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    batch = events.first_requests(df, "key", "ts", "20 minutes")
    assert sorted(r.key for r in spark.table("firsts").collect()) == sorted(r.key for r in batch.collect()) == sorted(f"k{k}" for k in range(40))
    assert {(r.key, r.ts) for r in batch.collect()} == {(f"k{k}", at(k * 30)) for k in range(40)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 15  # the watermark clears what is past


def test_requests_come_again_after_the_time(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    df = spark.createDataFrame([("a", at(m)) for m in (0, 5, 9, 10, 12, 25, 25)] + [(None, at(1)), (None, at(2)), ("b", None)], "key string, ts timestamp")
    got = sorted((str(r.key), r.ts) for r in events.first_requests(df, "key", "ts", "10 minutes").collect())
    assert got == [("None", at(1)), ("a", at(0)), ("a", at(10)), ("a", at(25))]


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(9)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(rng.choice("abc"), at(rng.randrange(20_000)), float(k)) for k in range(150)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, value double")
    src = str(tmp_path / "src")
    df.repartition(3).write.parquet(src)
    time.sleep(1.1)  # files are read by their age: the last one moves the watermark beyond all others
    spark.createDataFrame([("z", at(200_000), 0.0)], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = events.sessions(stream, "user_id", gap="5 minutes", late="10 hours").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    want = sorted(map(tuple, events.sessions(df, "user_id", gap="5 minutes").collect()))
    assert sorted(map(tuple, spark.table("sessions").collect())) == want and len(want) > 20
