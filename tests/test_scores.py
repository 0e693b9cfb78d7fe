"""Response parsing and score vectors."""

import hashlib
import json

import pytest

from corpusloom.functions import scores as sc
from corpusloom.operators.scoring import parse_responses, to_result_rows


def _python_reference(resp: str):
    """The reference's behaviour on one answer (error -> 'ERROR' row)."""
    try:
        clean = resp.replace("```json", "").replace("```", "").strip()
        scores = json.loads(clean).get("scores", {})
        if not scores:
            return (None, 0.0, None, 0.0)
        s = sorted(scores.items(), key=lambda kv: kv[1], reverse=True)
        return (s[0][0], s[0][1], s[1][0] if len(s) > 1 else None, s[1][1] if len(s) > 1 else 0.0)
    except Exception:
        return ("ERROR", 0.0, "ERROR", 0.0)


CASES = [
    '{"scores": {"a": 0.2, "b": 0.7, "c": 0.1}}',
    '{"scores": {"b": 0.5, "a": 0.5}}',            # tie: first key wins
    '{"scores": {"x": 0.9}}',                      # single entry
    '{"scores": {}}',
    '{"scores": null}',
    '{"other": 1}',                                 # no scores key
    '{}',
    '[{"scores": {"a": 1}}]',                        # JSON list
    'not json',
    '{"scores": {"a": 0.2}} trailing',
    '```json\n{"scores": {"a": 0.3, "b": 0.4}}\n```',
    '  \n{"scores": {"a": 0.3}}\n ',
    '{"scores": []}',
    '{"scores": 0}',
    '{"scores": false}',
    '{"scores": [1, 2]}',
    '{"scores": "x"}',
    '{"a": 1},{"b": 2}',
]


@pytest.mark.parametrize("resp", CASES)
def test_result_row_matches_reference_semantics(spark, resp):
    df = spark.createDataFrame([("1", "t", "a", resp)], "LensID string, Title string, true_category string, response string")
    r = to_result_rows(df).first()
    assert (r.predicted_one, r.confidence_one, r.predicted_two, r.confidence_two) == _python_reference(resp)


def test_stated_divergences_are_errors(spark):
    # all-string scores (reference sorts text) and duplicate keys (reference keeps the last)
    df = spark.createDataFrame([('{"scores": {"a": "0.2", "b": "0.1"}}',), ('{"scores": {"a": 1, "a": 2}}',)],
                               "response string")
    got = [r._p.ok and r._p.scores is not None for r in parse_responses(df).collect()]
    assert got == [False, False]


def test_content_key_per_text(spark):
    df = spark.createDataFrame([("hello",)], "t string")
    want = hashlib.md5(b"hello").hexdigest()[:16] + "_m"
    assert df.select(sc.content_key("t", "m")).first()[0] == want


def test_argmax_softmax_top_two_vector(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7, 0.2], ["a", "b", "c", "d"]), ([1.0], ["only"])],
                               "p array<double>, k array<string>")
    rows = df.select(sc.argmax_label("p").alias("am"), sc.softmax("p").alias("sm"),
                     sc.top_two_from_vector("p", "k").alias("t")).collect()
    assert rows[0].am == 1
    assert abs(sum(rows[0].sm) - 1.0) < 1e-12
    # exact tie favours the later class; second is (null, 0.0) with one class
    assert (rows[0].t.k1, rows[0].t.k2) == ("c", "b")
    assert (rows[1].t.k1, rows[1].t.k2, rows[1].t.v2) == ("only", None, 0.0)
