"""Live byte guard: order, bounds and white space like the batch guard's; canonical JSON; files and manifests."""

import random

import pytest

from gatewarden.functions.patterns import compiles
from gatewarden.functions.text import compact
from gatewarden.operators.streams import guard_bytes
from gatewarden.streaming.guard import HELD, Live, Stage


def run(raw: bytes, cuts, order=None, errors=True):
    cuts = [0, *sorted(cuts), len(raw)]
    parts = [(i, raw[a:b], b == len(raw) and i == len(cuts) - 2) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    live, out = Live(True, errors), []
    for i in order or range(len(parts)):
        out += live.take(*parts[i])
    assert [x[0] for x in out] == sorted(x[0] for x in out) and not live.waiting
    return b"".join(x[1] for x in out), sum(x[2] for x in out), sum(x[3] for x in out)


def test_live_equals_batch(spark):
    r = random.Random(1)
    pieces = ["Bearer tokà rest ", "Bearer x ", 'data: {"message" : "fail \\" at", "n": 1}\n', "sk-test-1234567890 ", "ghp_" + "a" * 30, " plain é text ", 'sk- "message', "eyJa.eyJb.c "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 7))).encode() for _ in range(60)] + [bytes([0, 255, 0xA0]) + b" Bearer \xa0tok\xa0 end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "stream_id long, body binary")
    want = {x["stream_id"]: (bytes(x["body"]), x["redactions"], x["sanitized"]) for x in guard_bytes(df, True, True).collect()}
    for i, t in enumerate(texts):
        for _ in range(4):
            cuts = sorted(r.sample(range(1, len(t)), min(r.randrange(6), len(t) - 1)))
            order = list(range(len(cuts) + 1))
            r.shuffle(order)
            assert run(t, cuts, order) == want[i], t


def test_state_is_bounded():
    for token, out in (("Bearer " + "x" * 300_000, "[REDACTED]"), ("sk-1" + "y" * 300_000, "[REDACTED]"), ("sk-" + "z" * 300_000, None), ('"message": "' + "w" * 300_000, None)):
        live, got, most = Live(True, True), "", 0
        text = "a " + token + " b"
        for i in range(0, len(text), 1000):
            got += live.feed(text[i : i + 1000], i + 1000 >= len(text))[0]
            most = max(most, len(live.first.kept) + len(live.second.kept))
        assert most <= 2 * HELD and got == ("a " + (out or token) + " b")
    assert Stage().secrets("", True) == ("", 0)


@pytest.mark.parametrize(
    "text, want",
    [
        ("[0.00001,1e-7,1E21,123456789012345680000,-0,1.50,12345678901234567890,1e400]", "[0.00001,1e-7,1e+21,123456789012345680000,0,1.5,12345678901234567000,null]"),
        ('{"b":1,"10":2,"2":3,"a":4,"01":5,"b":6}', '{"2":3,"10":2,"b":6,"a":4,"01":5}'), ('"\\ud800 \\ud83d\\ude00 \\u0001"', '"\\ud800 😀 \\u0001"'),
        ("NaN", None), ("[Infinity]", None), ("{", None), (None, None), ("[" * 5000 + "]" * 5000, None), ("5e-324", "5e-324"), ("0.1", "0.1"), ("100", "100"), ("-1.5e-9", "-1.5e-9"),
    ],
)
def test_compact(text, want):
    assert compact(text) == want


def test_patterns_of_the_dialect():
    assert all(map(compiles, (r"(?<n>x)\k<n>", r"\-\_\/", r"[^]", r"(?<=a+)b", r"\y", "a{", r"\u{1F}")))
    assert not any(map(compiles, ("(", "[a", "*a", "(?<n>x", "a**")))


def test_files_below_skipped_names(spark, tmp_path):
    from gatewarden.sources.files import manifest_files, parse_manifest, read_files, validate_manifest

    root = tmp_path / "dist" / "app"
    for rel in ("a.txt", "dist/b.txt", "src/tools/v1/a.json", "TOOLS/x.yaml", "tools/x.yaml", "apps/tools/y.yaml", "app2/tools.json", "test/fixtures/policies/invalid/tools.json", "node_modules/tools.json"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text('{"tools": []}')
    names = lambda df: sorted(r["file"].split("/dist/app/")[1] for r in df.select("file").collect())
    assert "a.txt" in names(read_files(spark, str(root))) and "dist/b.txt" not in names(read_files(spark, str(root)))
    assert names(manifest_files(spark, str(root))) == ["app2/tools.json", "apps/tools/y.yaml", "src/tools/v1/a.json"]
    assert names(manifest_files(spark, str(root), include=["app"])) == [] and names(manifest_files(spark, str(root), include=["app2/"], exclude=["app"])) == ["app2/tools.json"]
    assert names(manifest_files(spark, "/", manifest=str(root / "a.txt"))) == ["a.txt"]
    _, tools, strings, error = parse_manifest("m.json", '{"tools":[{"description":"rm -rf /"},"plain",{"function":{"name":"f"}}]}')
    assert (tools, [s[:2] for s in strings], error) == (["f"], [("description", "rm -rf /")], None)
    assert [p for p, _ in validate_manifest({"tools": [{"name": ""}, 3]})] == ["version", "tools[0].name", "tools[1]"]


def test_policy_shapes():
    from gatewarden.plans import policy as P

    codes = lambda *rules, **more: [e.code[-4:] for e in P.validate({"version": "1", "rules": list(rules), **more})[1]]
    assert codes({"allowTools": ["a"]}) == codes({"maxToolArgsBytes": 5}) == codes({"maxToolArgsBytes": {"max": 1.5}}) == ["E002"]
    assert codes({"blockToolArgs": {"contains": 5}}) == ["E007"] and codes({"blockToolArgs": {"pattern": "(?<n>x)"}}) == []
    assert codes({"allowTools": {"names": ["a"]}}, {"denyTools": {"names": ["a"]}}, {"denyTools": {"names": ["b"]}}) == []
    assert [x.code for x in P._conflicts([{"allowTools": {"names": []}}], "block")] == ["POLICY_E010"]
    a, b = {"rules": [{"denyTools": {"names": ["x"]}}]}, {"mode": "warn", "byte": {}, "extends": "p", "rules": []}
    assert [(x["kind"], x["path"], x["before"], x["after"]) for x in P.diff(a, b)] == [("changed", "mode", None, "warn"), ("changed", "extends", None, "p"), ("removed", "rules.denyTools", {"denyTools": {"names": ["x"]}}, None)]
