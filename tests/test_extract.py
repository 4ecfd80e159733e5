import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import images, ocr
from sheafline.plans import stages
from sheafline.plans.extract import Rules, extract
from sheafline.sources import config, sinks


def model():
    def run(prompt):
        text = prompt.split("\n", 1)[1]
        if "<ocr_text>" in text:
            return {"raw_text": '{"it":[{"n":"From lines","t":"9.000"}],"mn":"Phiếu thanh toán"}', "finish_reason": "stop"}
        seen = base64.b64decode(text).decode()
        if seen.startswith("loop"):
            return {"raw_text": json.dumps({"it": [{"n": "A", "t": 1}] * 12, "mn": "Shop"}), "finish_reason": "stop"}
        if seen.startswith("fail"):
            raise RuntimeError("no model")
        return {"raw_text": '{"ly":"COMPLETE","mn":"Shop","it":[{"n":"Tip"},{"n":"Phở .","t":"45.000 đ"}],"td":"15-01-2024"}', "finish_reason": "stop"}

    return run


def reader():
    return lambda content: {"texts": bytes(content).decode().splitlines()[1:], "scores": [0.9] * (len(bytes(content).decode().splitlines()) - 1)}


def test_from_payload_to_answer(spark, tmp_path):
    coded = lambda t: [base64.b64encode(t.encode()).decode()]
    rows = [(None, coded("good"), "a"), (None, coded("loop\nNgày 01/02/2024"), "b"), (None, coded("fail"), "c"), (None, None, "d"), (None, ["@@@"], "e"), (None, coded("good"), "N/A")]
    df = spark.createDataFrame(rows, "images_url array<string>, images_base64 array<string>, reference_id string")
    answers, rejected = extract(df, model, reader, Rules(items=["tip"], merchants=["phieu thanh toan"]))
    got = {r.ref: r for r in answers.collect()}
    assert {r.reference_id for r in rejected.collect()} == {"d", "e"}
    assert len(got) == 4 and sum(r.startswith("auto-") for r in got) == 1
    assert (got["a"].engine, got["a"].merchant_name, got["a"].transaction_date) == ("vllm", "Shop", "2024-01-15")
    assert [(i.name, i.total) for i in got["a"]["items"]] == [("Phở", 45000.0)]
    assert (got["b"].engine, got["b"].trigger.split()[0], got["b"].transaction_date, got["b"].merchant_name) == ("paddle", "hallu:dup_items_run", "2024-02-01", None)
    assert (got["c"].engine, got["c"].trigger, got["c"]["items"]) == ("paddle", "vlm_upstream_error", [])
    sinks.write_answers(answers, f"file://{tmp_path}/out")
    assert {json.loads(r.answer)["merchant_name"] for r in spark.read.json(f"file://{tmp_path}/out").collect()} == {"Shop", None}


def test_blocks_read_back(spark):
    lines = [("a|b", 2, 4, 20, 30, 0.9, 17.0), ("c", 0, 40, 8, 60, 0.9, 50.0)]
    df = spark.createDataFrame([(lines,)], f"l array<{ocr.LINE}>")
    got = df.select(ocr.parse_block(ocr.text_block(F.col("l"))).alias("p")).first().p
    assert [tuple(x)[:5] for x in got] == [x[:5] for x in lines]


def coded(text):
    return [base64.b64encode(text.encode()).decode()]


def counted(tmp_path, name, inner):
    """A provider that leaves a file for each call."""
    folder = tmp_path / name
    folder.mkdir()
    path = str(folder)

    def make():
        import os
        import uuid

        run = inner()

        def one(x):
            open(os.path.join(path, uuid.uuid4().hex), "w").close()
            return run(x)

        return one

    return make, lambda: len(list(folder.iterdir()))


def test_each_model_is_asked_once_and_refs_may_repeat(spark, tmp_path):
    rows = [(None, coded(t), r) for t, r in [("good", "a"), ("good", "a"), ("good", "a")] + [("loop\nNgày 01/02/2024", "b")] * 3 + [("fail", None), ("good", None), ("good", None)]]
    df = spark.createDataFrame(rows, "images_url array<string>, images_base64 array<string>, reference_id string").repartition(3)
    complete, completions = counted(tmp_path, "complete", model)
    recognise, recognitions = counted(tmp_path, "recognise", reader)
    answers, rejected = extract(df, complete, recognise, Rules())
    got = answers.collect()
    assert len(got) == 9 and rejected.count() == 0
    assert sorted(r.ref for r in got if r.ref in "ab") == ["a"] * 3 + ["b"] * 3
    assert {r.engine for r in got if r.ref == "a"} == {"vllm"} and {r.engine for r in got if r.ref == "b"} == {"paddle"}
    # Nine requests, three looping ones and a failed one: the latter has no line to make a prompt of.
    assert recognitions() == 4 and completions() in (12, 13)


def test_a_model_that_writes_in_pieces_is_stopped_where_it_loops(spark, tmp_path):
    path = str(tmp_path / "n")

    def writer():
        def run(prompt):
            if "<ocr_text>" in prompt:
                return {"raw_text": '{"mn":"Lines","it":["Tea"]}', "finish_reason": "stop"}
            if base64.b64decode(prompt.split("\n", 1)[1]).decode().startswith("calm"):
                return iter(['{"mn":"Sh', 'op"}'])

            def pieces():
                yield '{"it":['
                for k in range(10_000):
                    with open(path, "a") as file:
                        file.write("x")
                    yield '{"n":"Phở","t":1},'

            return pieces()

        return run

    df = spark.createDataFrame([(None, coded("calm"), "a"), (None, coded("loop\nline"), "b")], "images_url array<string>, images_base64 array<string>, reference_id string").coalesce(1)
    got = {r.ref: r for r in extract(df, writer, reader, Rules())[0].collect()}
    assert (got["a"].engine, got["a"].merchant_name, got["a"].trigger) == ("vllm", "Shop", None)
    assert (got["b"].trigger, got["b"].merchant_name) == ("hallu:stream_abort", "Lines")
    assert len(open(path).read()) < 100


def test_lines_stand_at_the_recognisers_boxes_and_prompts_are_cut_to_the_cap(spark):
    def boxes():
        def run(content):
            at = lambda x, y: [{"x": float(x), "y": float(y)}, {"x": float(x + 60), "y": float(y)}, {"x": float(x + 60), "y": float(y + 20)}, {"x": float(x), "y": float(y + 20)}]
            n = int(bytes(content).decode().split()[1])
            return {"texts": [f"t{k}" for k in range(n)], "scores": [0.9] * n, "polys": [at(10 if k else 90, 10 if k < 2 else 40 * k) for k in range(n)]}

        return run

    def echo():
        def run(prompt):
            if "<ocr_text>" not in prompt:
                raise RuntimeError("down")
            return {"raw_text": json.dumps({"ma": prompt.split("<ocr_text>\n")[1][:200].replace("\n", ";")}), "finish_reason": "stop"}

        return run

    df = spark.createDataFrame([(None, coded("x 3"), "few"), (None, coded("x 100"), "many"), (None, coded("x 0"), "none")], "images_url array<string>, images_base64 array<string>, reference_id string")
    got = {r.ref: r for r in extract(df, echo, boxes, Rules(input_cap=60))[0].collect()}
    # The first two lines share a row, left to right.
    assert got["few"].merchant_address.startswith("5,5,75,15|t1 t0;")
    assert got["many"].engine == "paddle" and got["none"].merchant_address is None


# ---- image stages ----

def page(width=400, height=300, bars=tuple((y, y + 20) for y in range(40, 270, 30)), upright=True):
    image = np.full((height, width, 3), 255, np.uint8)
    for a, b in bars:
        image[a:b, 50:350] = 0
    return image if upright else np.ascontiguousarray(np.rot90(image, 3))


def bars():
    """A stand-in detector: dark bars, lying or standing."""
    def run(image):
        g = image[:, :, 0] < 128
        if not g.any():
            raise RuntimeError("blank")
        flat = g.any(axis=0).sum() >= g.any(axis=1).sum()
        lines = g.any(axis=1) if flat else g.any(axis=0)
        edge = np.flatnonzero(np.diff(np.r_[0, lines.astype(int), 0]))
        across = np.flatnonzero(g.any(axis=0 if flat else 1))
        polys = []
        for a, b in zip(edge[::2], edge[1::2]):
            box = [(across[0], a), (across[-1] + 1, a), (across[-1] + 1, b), (across[0], b)]
            polys.append(box if flat else [(y, x) for x, y in box])
        return {"polys": polys, "label": None if flat else "90"}

    return run


def test_pages_are_turned_cut_and_scaled(spark, tmp_path):
    find, finds = counted(tmp_path, "find", bars)
    blank = np.random.default_rng(2).integers(160, 256, (200, 200, 3), dtype=np.uint8)
    rows = [("up", images.encode_ppm(page())), ("side", images.encode_ppm(page(upright=False))), ("junk", b"no image"), ("blank", images.encode_ppm(blank)), ("null", None)]
    df = spark.createDataFrame([(k, bytearray(c) if c is not None else None, 7) for k, c in rows], "ref string, content binary, page int")
    drawn = config.load((), {"PP2_QUALITY_DIGITAL_BYPASS": "0"})  # bars on plain paper look like a screenshot
    out = stages.prepare(df, lambda: images.decode_ppm, find, lambda: images.encode_ppm, drawn)
    assert out.columns[:3] == ["ref", "content", "page"]
    got = {r.ref: r for r in out.collect()}
    assert finds() == 4  # three pages, and the turned one again
    for ref in ("up", "side"):
        r = got[ref]
        image = images.decode_ppm(bytes(r.content))
        h, w = image.shape[:2]
        # The text's box with its padding, brought to the least area in whole blocks.
        assert w % 32 == h % 32 == 0 and 1_048_576 <= w * h < 1_300_000 and w / h == pytest.approx(340 / 270, rel=0.1)
        assert (image[:, :, 0] < 128).any(axis=0).mean() == pytest.approx(300 / 340, abs=0.03) and r.image_quality.input_long_side == 400
        assert set(r.stages) >= {"ingest", "quality", "detect", "orient", "localize", "fit"} and all(s.error is None for s in r.stages.values())
        assert r.total_ms >= 0 and r.image_quality.median_text_height_px == 20.0 and r.verdict in ("readable", "marginal")
    assert got["junk"].content == b"no image" and got["junk"].stages["ingest"].error and got["junk"].image_quality is None
    assert got["null"].content is None and got["blank"].stages["detect"].error == "RuntimeError: blank" and got["blank"].verdict == "unreadable"
    off = config.load((), {"PP2_QUALITY_DIGITAL_BYPASS": "0", "PP2_ORIENT_ENABLED": "0", "PP2_LOCALIZE_ENABLED": "0", "PP2_FIT_ENABLED": "0", "PP2_GATE_ENABLED": "0"})
    plain = {r.ref: r for r in stages.prepare(df, lambda: images.decode_ppm, bars, lambda: images.encode_ppm, off).collect()}
    assert plain["side"].content == dict(rows)["side"] and plain["blank"].verdict == "readable"


def test_answers_carry_image_quality(spark, tmp_path):
    data = base64.b64encode(images.encode_ppm(page())).decode()
    df = spark.createDataFrame([(None, [data], "a"), (None, coded("junk"), "b")], "images_url array<string>, images_base64 array<string>, reference_id string")

    def shop():
        return lambda prompt: {"raw_text": '{"mn":"Shop"}', "finish_reason": "stop"}

    answers, _ = extract(df, shop, reader, Rules(), stages=lambda rows: stages.prepare(rows, lambda: images.decode_ppm, bars, lambda: images.encode_ppm))
    sinks.write_answers(answers, f"file://{tmp_path}/out")
    got = {r.ref: json.loads(r.answer) for r in spark.read.json(f"file://{tmp_path}/out").collect()}
    assert got["a"]["image_quality"]["input_long_side"] == 400 and got["b"]["image_quality"] is None and got["a"]["merchant_name"] == "Shop"


# ---- models of the stages ----


def shaded(turns=0, paper=255, ink=0):
    """A page whose bars are lighter at their upper edge, turned counter-clockwise."""
    image = np.full((300, 400, 3), paper, np.uint8)
    for y in range(40, 270, 30):
        image[y : y + 10, 50:350], image[y + 10 : y + 20, 50:350] = ink + 50, ink
    return np.ascontiguousarray(np.rot90(image, turns))


def line_model():
    """A stand-in text-line model: a crop stands on its head if its upper half is the darker one; None where it cannot tell."""
    def run(crops):
        out = []
        for c in crops:
            a, b = c[: len(c) // 2].mean(), c[(len(c) + 1) // 2 :].mean()
            out.append(None if a == b else bool(a < b))
        return out

    return run


DRAWN = {"PP2_QUALITY_DIGITAL_BYPASS": "0", "PP2_FIT_ENABLED": "0", "PP2_LOCALIZE_ENABLED": "0"}


def prepared(spark, images_by_name, env, find=bars, **models):
    df = spark.createDataFrame([(k, bytearray(images.encode_ppm(v))) for k, v in images_by_name.items()], "ref string, content binary")
    return {r.ref: r for r in stages.prepare(df, lambda: images.decode_ppm, find, lambda: images.encode_ppm, config.load((), env), **models).collect()}


def test_text_lines_turn_what_polygons_cannot_tell(spark, tmp_path):
    lines, asked = counted(tmp_path, "lines", line_model)
    pages = {f"{t}": shaded(t) for t in range(4)}
    got = prepared(spark, pages, DRAWN, lines=lines)
    for name, r in got.items():
        assert (images.decode_ppm(bytes(r.content)) == pages["0"]).all(), name
        assert r.stages["textline"].error is None
    assert asked() == 4  # once a page, all turns in one batch
    # Without the model, pages on their head stay so, and the detector's label is believed.
    plain = prepared(spark, pages, DRAWN)
    assert (images.decode_ppm(bytes(plain["2"].content)) == pages["2"]).all() and (images.decode_ppm(bytes(plain["1"].content)) == pages["2"]).all()


def test_votes_take_the_largest_crops_and_fail_in_their_row(spark):
    seen = lambda n: (lambda: lambda crops: [len(crops) != n] * len(crops))
    of = lambda env, n: (images.decode_ppm(bytes(prepared(spark, {"a": shaded(0)}, DRAWN | env, lines=seen(n))["a"].content)) == shaded(0)).all()
    assert of({}, 5) and of({"PP2_ORIENT_TEXTLINE_SAMPLE": "3"}, 3) and not of({"PP2_ORIENT_TEXTLINE_SAMPLE": "3"}, 5)
    # No crop is large enough: the model is not asked.
    assert of({"PP2_ORIENT_TEXTLINE_MIN_SIDE_PX": "21"}, -1)

    def broken():
        return lambda crops: [True]

    r = prepared(spark, {"a": shaded(0)}, DRAWN, lines=broken)["a"]
    assert "1 answers to 5 crops" in r.stages["textline"].error and (images.decode_ppm(bytes(r.content)) == shaded(0)).all()


def bright():
    return lambda crops: [float(c.mean()) / 255 for c in crops]


def test_marginal_pages_take_even_light_where_it_reads_better(spark, tmp_path):
    score, asked = counted(tmp_path, "score", bright)
    poor = DRAWN | {"PP2_GATE_MARGINAL_BLUR": "1e9", "PP2_GATE_VARIANTS_ENABLED": "1", "PP2_PHOTOMETRIC_CLAHE_CLIP": "0.01"}
    pages = {"dim": shaded(paper=160, ink=60)}
    got = prepared(spark, pages, poor, score=score)["dim"]
    assert (got.verdict, got.light) == ("marginal", "photometric") and asked() == 1 and got.stages["gate"].error is None
    assert (images.decode_ppm(bytes(got.content)) == images.even_light(pages["dim"], 0.125, 0.01, 8)).all()
    # Too little gain, a readable page, no variants: the page stays as it is.
    for env, calls, light in (({"PP2_GATE_VARIANT_MIN_GAIN": "5"}, 2, "minimal"), ({"PP2_GATE_MARGINAL_BLUR": "0", "PP2_GATE_MARGINAL_TEXT_H": "0"}, 2, None), ({"PP2_GATE_VARIANTS_ENABLED": "0"}, 2, None)):
        r = prepared(spark, pages, poor | env, score=score)["dim"]
        assert (r.light, asked()) == (light, calls) and (images.decode_ppm(bytes(r.content)) == pages["dim"]).all()


def test_the_scorer_gets_both_lights_of_the_largest_crops(spark):
    def of(wanted):
        return lambda: lambda crops: [1.0 if k >= len(crops) // 2 else 0.0 for k in range(len(crops))] if len(crops) == wanted else []

    poor = DRAWN | {"PP2_GATE_MARGINAL_BLUR": "1e9", "PP2_GATE_VARIANTS_ENABLED": "1"}
    assert prepared(spark, {"a": shaded()}, poor, score=of(16))["a"].light == "photometric"  # eight bars, twice
    assert prepared(spark, {"a": shaded()}, poor | {"PP2_GATE_VARIANT_SAMPLE": "3"}, score=of(6))["a"].light == "photometric"
    assert prepared(spark, {"a": shaded()}, poor, score=of(5))["a"].light is None  # no scores: nothing is chosen

    def broken():
        def run(crops):
            raise RuntimeError("no scorer")

        return run

    r = prepared(spark, {"a": shaded()}, poor, score=broken)["a"]
    assert r.light is None and r.verdict == "marginal" and r.stages["gate"].error == "RuntimeError: no scorer"


def test_digital_pages_pass_by(spark, tmp_path):
    find, finds = counted(tmp_path, "find", bars)
    score, scores = counted(tmp_path, "score", bright)
    lines, asked = counted(tmp_path, "lines", line_model)
    env = {"PP2_FIT_ENABLED": "0", "PP2_GATE_VARIANTS_ENABLED": "1", "PP2_GATE_MARGINAL_BLUR": "1e9", "PP2_PHOTOMETRIC_ENABLED": "1"}
    got = prepared(spark, {"screen": shaded(1)}, env, find=find, score=score, lines=lines)["screen"]
    assert (got.route, got.verdict, got.reject_reason, finds(), scores(), asked()) == ("digital", "readable", None, 0, 0, 0)
    assert (images.decode_ppm(bytes(got.content)) == shaded(1)).all()


def test_reasons_and_routes_reach_the_answers(spark):
    pages = {"few": np.random.default_rng(1).integers(100, 256, (60, 60, 3), dtype=np.uint8), "good": shaded()}
    rows = [(None, [base64.b64encode(images.encode_ppm(v)).decode()], k) for k, v in pages.items()]
    df = spark.createDataFrame(rows, "images_url array<string>, images_base64 array<string>, reference_id string")
    find = lambda: (lambda image, b=bars(): b(image) if image.shape[0] > 100 else {"polys": []})
    shop = lambda: (lambda prompt: {"raw_text": '{"mn":"Shop"}', "finish_reason": "stop"})
    drawn = config.load((), {"PP2_QUALITY_DIGITAL_BYPASS": "0"})
    answers, _ = extract(df, shop, reader, Rules(), stages=lambda rows: stages.prepare(rows, lambda: images.decode_ppm, find, lambda: images.encode_ppm, drawn))
    got = {r.ref: r for r in answers.collect()}
    assert (got["few"].verdict, got["few"].reject_reason) == ("unreadable", "no_text_detected(n_polys=0<3)")
    assert (got["good"].reject_reason, got["good"].route, got["good"].merchant_name) == (None, "photo", "Shop")
    suppressed = prepared(spark, {"few": pages["few"]}, {"PP2_GATE_REJECT_ENABLED": "0"}, find=find)["few"]
    assert (suppressed.verdict, suppressed.reject_reason) == ("marginal", None)
