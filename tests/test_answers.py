from casework.functions.answers import parse_answers, parse_judgements


# Answer and what it says: (intent, confidence, escalate, reason), or None for no usable answer.
CASES = [
    ('{"intent":"other","confidence_score":0.9,"should_escalate":false,"escalation_reason":" x "}', ("other", 0.9, False, "x")),
    ('```json\n{"intent":"hardware_repair","confidence_score":0.7,"should_escalate":true}\n```', ("hardware_repair", 0.7, True, "")),
    ('```JSON\n{"intent":" billing_purchases "}\n```', ("billing_purchases", 0.0, False, "")),
    ('  {"intent":"Hardware_Repair","confidence_score":"0.8","should_escalate":"false"}  ', ("other", 0.8, True, "")),
    ('{"intent":null,"confidence_score":7,"should_escalate":0}', ("other", 1.0, False, "")),
    ('{"confidence_score":-1,"should_escalate":1.5}', ("other", 0.0, True, "")),
    ('{"confidence_score":"abc","should_escalate":[]}', ("other", 0.0, False, "")),
    ('{"confidence_score":" 1e-1 ","should_escalate":[0]}', ("other", 0.1, True, "")),
    ('{"confidence_score":"nan","should_escalate":{}}', ("other", 1.0, False, "")),
    ('{"confidence_score":"-inf","should_escalate":{"a":1}}', ("other", 0.0, True, "")),
    ('{"confidence_score":"Infinity","should_escalate":""}', ("other", 1.0, False, "")),
    ('{"confidence_score":true,"should_escalate":"no"}', ("other", 1.0, True, "")),
    ('{"confidence_score":[1],"should_escalate":null}', ("other", 0.0, False, "")),
    ('{"confidence_score":null,"escalation_reason":null}', ("other", 0.0, False, "")),
    ('{"confidence_score":0.5,"escalation_reason":0}', ("other", 0.5, False, "")),
    ('{"confidence_score":0.5,"escalation_reason":12}', ("other", 0.5, False, "12")),
    ('{"confidence_score":0.5,"escalation_reason":true}', ("other", 0.5, False, "True")),
    ('{"confidence_score":0.5,"escalation_reason":false}', ("other", 0.5, False, "")),
    ('{"confidence_score":"1d"}', ("other", 0.0, False, "")),
    ('{"intent":["other"]}', ("other", 0.0, False, "")),
    # As Python reads it: the last of equal keys counts, NaN and Infinity are numbers, lists show as Python's.
    ('{"intent":"refunds","confidence_score":0.1,"intent":"other","confidence_score":"0.4"}', ("other", 0.4, False, "")),
    ('{"should_escalate":true,"should_escalate":null}', ("other", 0.0, False, "")),
    ('{"confidence_score":NaN,"should_escalate":NaN,"escalation_reason":NaN}', ("other", 1.0, True, "nan")),
    ('{"confidence_score":Infinity,"escalation_reason":-Infinity}', ("other", 1.0, False, "-inf")),
    ('{"confidence_score": -Infinity, "escalation_reason":"say NaN, \\"Infinity\\""}', ("other", 0.0, False, 'say NaN, "Infinity"')),
    ('{"escalation_reason":["a", 1, 1.5, true, null, {"b c": [], "d": false}]}', ("other", 0.0, False, "['a', 1, 1.5, True, None, {'b c': [], 'd': False}]")),
    ('{"escalation_reason":{"it\'s": "x, \\"y\\": z"}}', ("other", 0.0, False, '{"it\'s": \'x, "y": z\'}')),
    ('{"escalation_reason":["null", "both \' and \\""]}', ("other", 0.0, False, "['null', 'both \\' and \"']")),
    ('{"escalation_reason":[]}', ("other", 0.0, False, "")),
    ('{"other":1,"other":{"x":1}}', ("other", 0.0, False, "")),
    *[(bad, None) for bad in ('{"intent":"other"} and more', "[NaN]", '{"intent":"other",}', "{'intent':'other'}", "NaN")],
    ("{}", ("other", 0.0, False, "")),
    *[(bad, None) for bad in ("not json", "[1]", "", "   ", "null", "12", '"text"', None, '{"intent":"other"')],
]
ANSWERS = [answer for answer, _ in CASES]


def test_parse_answer(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    for row in parse_answers(df).collect():
        got = tuple(row.analysis) if row.analysis else None
        assert got == CASES[row.i][1], ANSWERS[row.i]
        assert (row.error is None) == (got is not None)


def test_rows_are_kept_and_helpers_are_not(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "id int, answer string")
    out = parse_answers(df)
    assert out.columns == ["id", "answer", "analysis", "error"] and out.count() == len(ANSWERS)


def test_parse_judgement(spark):
    cases = [
        ('{"score_tone":5,"score_grounding":"4","reasoning":"ok"}', 5, 4, "ok"),
        ('{"score_tone":6,"score_grounding":null}', None, None, None),
        ('{"score_tone":0,"score_grounding":4.9}', None, 4, None),
        ('{"score_tone":"4.7","score_grounding":" 3 "}', None, 3, None),
        ('{"score_tone":true,"score_grounding":[1]}', 1, None, None),
        ('```json\n{"score_tone":2,"score_grounding":1}\n```', 2, 1, None),
        ("junk", None, None, None), ("[]", None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, answer string")
    for row in parse_judgements(df).collect():
        assert tuple(row.judgement) == cases[row.i][1:], cases[row.i]
