from __future__ import annotations

import copy
import http.server
import json
import random
import threading

import pytest
from annoweave.operators import inference as inf
from annoweave.operators import validation as v
from annoweave.schemas import FLAGS, LABELS, PREDICTION_KEYS, PROMPT_FIELDS
from pyspark.sql import functions as F

IDS = ["eng_000001", "eng_000002", "eng_000003"]
GOOD = {"schema_version": "bloom_v1", "predictions": [{"record_id": i, "bloom_label": "Denial", "flags": dict.fromkeys(FLAGS, "No"), "comments": ""} for i in IDS]}


def broken(change):
    out = copy.deepcopy(GOOD)
    return out if (got := change(out)) is None else got


CASES = {
    "V-1": lambda p: [],
    "V-2": lambda p: p.update(schema_version="v2"),
    "V-3": lambda p: p.update(predictions={}),
    "V-4": lambda p: p["predictions"].__setitem__(1, 7),
    "V-5": lambda p: p["predictions"][1].update(why=1),
    "V-6": lambda p: p["predictions"][1].pop("comments") and None,
    "V-7": lambda p: p["predictions"][1].update(record_id=["eng_000002"]),
    "V-8": lambda p: p["predictions"][1].update(record_id=IDS[0]),
    "V-9": lambda p: p["predictions"][1].update(bloom_label="denial"),
    "V-10": lambda p: p["predictions"][1].update(flags="No"),
    "V-11": lambda p: p["predictions"][1]["flags"].update(more="No"),
    "V-12": lambda p: p["predictions"][1]["flags"].update(singing={"x": 1}),
    "V-13": lambda p: p["predictions"][1].update(comments=None),
    "V-14": lambda p: p["predictions"][1].update(comments="é" * 301),
    "V-15": lambda p: p["predictions"].pop() and None,
}
CASES["V-6"] = lambda p: p["predictions"][1].__delitem__("comments")


def verdicts(spark, *replies, ids=IDS):
    """(code, message, predictions) of each reply, given as text or payload."""
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r), ids) for i, r in enumerate(replies)]
    df = v.with_verdict(spark.createDataFrame(rows, "i int, t string, ids array<string>"), "t", "ids")
    return [tuple(r.v) for r in sorted(df.collect(), key=lambda r: r.i)]


def test_each_check(spark):
    assert [x[0] for x in verdicts(spark, *(broken(c) for c in CASES.values()))] == list(CASES)


def test_valid_order_and_counts(spark):
    p = copy.deepcopy(GOOD)
    p["predictions"].reverse()
    p["predictions"][0]["comments"] = "é" * 300
    (code, message, found), = verdicts(spark, p)
    assert code is message is None and [f["record_id"] for f in found] == IDS[::-1] and found[0].comments == "é" * 300
    assert verdicts(spark, GOOD, ids=[*IDS, IDS[0]])[0][0] == "V-16"


def test_precedence(spark):
    later = broken(lambda p: (p["predictions"][1].update(bloom_label="x", flags=1), p["predictions"][2].update(more=1))[0])
    twice = broken(lambda p: (p.update(schema_version=1), p.update(predictions=1))[0])
    missing = broken(lambda p: (p["predictions"].pop(0), p["predictions"][1].update(comments=5))[0] and None)
    assert [x[0] for x in verdicts(spark, later, twice, missing)] == ["V-9", "V-2", "V-13"]


def rule(payload, expected):
    """The code of the first broken check, from the published list of checks."""
    if not isinstance(payload, dict):
        return "V-1"
    if payload.get("schema_version") != "bloom_v1":
        return "V-2"
    found, seen = payload.get("predictions"), []
    if not isinstance(found, list):
        return "V-3"
    text = lambda x, allowed: isinstance(x, str) and x in allowed
    for p in found:
        if not isinstance(p, dict):
            return "V-4"
        f = p.get("flags")
        rid = p.get("record_id")
        for code, fine in (
            ("V-5", set(p) <= set(PREDICTION_KEYS)), ("V-6", set(p) >= set(PREDICTION_KEYS)), ("V-7", text(rid, expected)), ("V-8", rid not in seen), ("V-9", text(p.get("bloom_label"), LABELS)),
            ("V-10", isinstance(f, dict)), ("V-11", isinstance(f, dict) and set(f) == set(FLAGS)), ("V-12", isinstance(f, dict) and all(text(x, ("Yes", "No")) for x in f.values())),
            ("V-13", isinstance(p.get("comments"), str)), ("V-14", len(str(p.get("comments"))) <= 300),
        ):
            if not fine:
                return code
        seen.append(rid)
    return "V-15" if set(expected) - set(seen) else "V-16" if len(found) != len(expected) else None


def test_random_faults_against_the_list_of_checks(spark):
    rng, payloads = random.Random(3), []
    odd = [None, 1, 2.5, True, "x", [], {}, ["eng_000001"], {"a": 1}, "Denial", "Yes", "eng_000001", "eng_000003", float("nan"), "c" * 301]
    for _ in range(400):
        p = copy.deepcopy(GOOD)
        for _ in range(rng.randrange(1, 4)):
            one = rng.choice(p["predictions"]) if isinstance(p.get("predictions"), list) and p["predictions"] else None
            kind = rng.randrange(8)
            if kind == 0:
                p[rng.choice(["schema_version", "predictions", "more"])] = rng.choice(odd)
            elif kind == 1 and isinstance(one, dict):
                one.pop(rng.choice(PREDICTION_KEYS), None)
            elif kind == 2 and one is not None:
                p["predictions"][0] = rng.choice(odd)
            elif kind == 3 and isinstance(one, dict) and isinstance(one.get("flags"), dict):
                one["flags"][rng.choice([*FLAGS, "more"])] = rng.choice(odd)
            elif isinstance(one, dict):
                one[rng.choice([*PREDICTION_KEYS, "more"] if kind == 4 else PREDICTION_KEYS)] = rng.choice(odd)
        payloads.append(p)
    found = [x[0] for x in verdicts(spark, *payloads)]
    assert found == [rule(p, IDS) for p in payloads]
    assert len(set(found)) > 10


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":1}', {"a": 1}), ('```json\n{"a":1}\n```', {"a": 1}), ('```{"a":1}```', {"a": 1}), ('```json\n{"a":1}', {"a": 1}), ('Sure: {"a":1} ok', {"a": 1}), ('{"a":1,"a":2}', {"a": 2}), (" [1] ", [1]),
        ("{1} {2}", None), ("none", None), ("", None), (None, None), ("} {", None), ("```", None), ('{"a": NaN, "b": -Infinity}', {"a": None, "b": None}), ('{"a": "\\ud800"}', {"a": "\ud800"}),
    ],
)
def test_json_out_of_replies(text, want):
    found = v.json_body(text)
    assert found is None if want is None else json.loads(found) == want


def test_columns(spark):
    df = spark.createDataFrame([(json.dumps(GOOD), IDS), (None, IDS), ("```json\n{\"b\": 1, \"a\": \"é\"}\n```", [])], "t string, ids array<string>")
    rows = v.with_verdict(df, "t", "ids").withColumn("j", v.extracted_json(F.col("t"))).collect()
    assert [r.v.code for r in rows] == [None, "json", "V-2"]
    assert rows[0].v.predictions[2].flags.singing == "No" and rows[2].j == '{"a":"é","b":1}' and rows[1].j is None
    assert v.with_verdict(df.limit(0), "t", "ids").count() == 0


def test_policy(spark):
    rows = [(f, lab) for f in FLAGS for lab in ("Excluded", "Denial")]
    df = spark.createDataFrame(rows, "f string, bloom_label string").withColumn("flags", F.struct(*[F.when(F.col("f") == x, "Yes").otherwise("No").alias(x) for x in FLAGS]))
    assert sorted(r.f for r in v.policy_violations(df).collect()) == ["mimicry", "not_a_negation", "singing"]


BAD, FINE = json.dumps(broken(CASES["V-9"])), json.dumps(GOOD)


def answers(*replies):
    """A client that gives its replies in turn, as told by what it is asked: the first, and again after each fault."""

    def client(system, user):
        # a batch's messages differ in the fault only, so a task that runs anew says the same
        n = 0 if inf.AGAIN not in user else 1 + ("more than once" in user)
        reply = replies[min(n, len(replies) - 1)]
        if reply is None:
            raise RuntimeError("down")
        return reply

    return client


def test_retry_with_feedback_and_failures(spark):
    records = spark.createDataFrame([(i, r) for i, r in enumerate(IDS)], "number long, record_id string")
    run = lambda *replies, retries=2: inf.code_batches(records, answers(*replies), "p", 5, retries).first()
    once = json.dumps(broken(CASES["V-8"]))
    r = run(BAD, FINE)
    assert (r.status, r.attempts, r.error, len(json.loads(r.predictions))) == ("ok", 2, None, 3)
    r = run(BAD, once, FINE)
    assert (r.status, r.attempts) == ("ok", 3)
    r = run(BAD, BAD)
    assert (r.status, r.attempts, r.predictions) == ("invalid", 3, None) and "no such label" in r.error and r.response == BAD
    assert run(BAD, FINE, retries=0).status == "invalid"
    assert tuple(run("nothing"))[2:4] == ("not_json", 1)
    r = run(BAD, None)
    assert (r.status, r.attempts, r.response) == ("unreachable", 2, None) and r.error == "down"


def test_messages_and_the_chat_client():
    first = inf.user_message([{"record_id": "é"}])
    assert "é" in first and inf.AGAIN not in first and inf.user_message([], "why").endswith(f"{inf.AGAIN} why")
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            said = {"/chat": {"message": {"content": "fine"}}, "/empty": {"message": {"content": ""}}, "/odd": [1]}.get(self.path)
            self.send_response(200 if said is not None else 500)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode() if said is not None else b"")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert inf.ChatClient(f"{url}/chat", "m", 0.5)("be brief", "hello") == "fine"
    asked = seen[0]
    assert (asked["model"], asked["stream"], asked["format"], asked["options"]) == ("m", False, "json", {"temperature": 0.5})
    assert [(m["role"], m["content"]) for m in asked["messages"]] == [("system", "be brief"), ("user", "hello")]
    for path in ("empty", "odd", "broken"):
        with pytest.raises(RuntimeError):
            inf.ChatClient(f"{url}/{path}", "m")("a", "b")
    server.shutdown()
    with pytest.raises(RuntimeError, match="no answer"):
        inf.ChatClient("http://127.0.0.1:9", "m", timeout=2)("a", "b")


def test_code_batches(spark):
    df = spark.createDataFrame([(i, f"eng_{i:06d}", "x" * i, "secret") for i in range(12)], "number long, record_id string, target_utterance string, bloom_1 string")
    results = inf.code_batches(df, inf.stub_client, batch_size=5)
    assert [len(r.record_ids) for r in results.orderBy("batch_number").collect()] == [5, 5, 2]
    found = inf.predictions_of(results).orderBy("batch_number", "pos").collect()
    assert [r.record_id for r in found] == [f"eng_{i:06d}" for i in range(12)]
    inf.require_all_ok(results)
    failing = inf.code_batches(df, lambda s, u: "{}", batch_size=12, max_retries=0)
    with pytest.raises(RuntimeError, match="batch 1 failed"):
        inf.require_all_ok(failing)
    with pytest.raises(ValueError):
        inf.code_batches(df, inf.stub_client, batch_size=0)


def test_prompts_hide_labels(spark):
    shown = inf.prompt_records(spark.createDataFrame([("a", "s", "L")], "record_id string, split string, bloom_1 string"))
    assert tuple(shown.columns) == PROMPT_FIELDS and "L" not in shown.first()


# Labels and raised flags of the policy's sixteen worked examples and three of the prompt's.
GOLDEN = [
    ("Nonexistence", ""), ("Rejection", "foreign_language_negation"), ("Rejection", ""), ("Rejection", ""), ("Denial", ""), ("Uncoded", "tag_question"),
    ("Nonpossession", ""), ("Nonpossession", ""), ("Uncoded", ""), ("Excluded", "singing not_a_negation"), ("Excluded", "mimicry"), ("Excluded", "not_a_negation"),
    ("Rejection", ""), ("Rejection", "repetition"), ("Denial", ""), ("Nonexistence", ""),
    ("Excluded", "mimicry"), ("Excluded", "not_a_negation"), ("Rejection", "repetition"),
]


def test_worked_examples_follow_the_policy(spark):
    rows = [(f"eng_{i:06d}", label, raised.split()) for i, (label, raised) in enumerate(GOLDEN, 1)]
    df = spark.createDataFrame(rows, "record_id string, bloom_label string, raised array<string>")
    df = df.withColumn("flags", F.struct(*[F.when(F.array_contains("raised", x), "Yes").otherwise("No").alias(x) for x in FLAGS]))
    assert v.policy_violations(df).count() == 0
    payload = {"schema_version": "bloom_v1", "predictions": [{"record_id": i, "bloom_label": lab, "flags": {f: "Yes" if f in r else "No" for f in FLAGS}, "comments": ""} for i, lab, r in rows]}
    assert verdicts(spark, payload, ids=[r[0] for r in rows])[0][0] is None


def test_schema_faults(spark):
    replies = [[], {"predictions": [{"record_id": "eng_1"}, {"record_id": 4}, 7], "more": 1}, GOOD]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(replies)], "i int, t string")
    faults = {r.i: r.f for r in df.withColumn("f", v.schema_faults(v.response_variant(F.col("t")))).collect()}
    assert faults[0] == ["the reply isn't an object"] and faults[2] == []
    assert faults[1] == ["key outside the schema: more", 'id of another form: "eng_1"', "id of another form: 4", "id of another form: null"]
