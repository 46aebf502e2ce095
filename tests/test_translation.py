"""Two rounds of calls: what is asked again, which targets fail, and that others go on."""

import pytest

from captionlake.operators import translation
from captionlake.operators.translation import translate_targets

UNITS = [(m, "en", u, f"text {m} {u}") for m in (1, 2) for u in range(1, 8)]


class Script:
    """A translator that answers by a rule over (whether it is asked for one unit, the id, the text)."""

    def __init__(self, rule):
        self.rule = rule

    def __call__(self, pairs):
        return [answer for i, t in pairs for answer in self.rule(len(pairs) == 1, i, t)]


def sound(alone, i, t):
    return [(i, f"<{t}>")]


def run(spark, translators, units=UNITS, targets=None, batch=3):
    u = spark.createDataFrame(units, "media_id long, lang string, unit_id long, text string")
    targets = targets or [(m, lang) for m in (1, 2) for lang in translators]
    done, status = translate_targets(u, spark.createDataFrame(targets, "media_id long, lang string"), translators, batch)
    got = {}
    for r in done.collect():
        assert got.setdefault((r.media_id, r.lang), {}).setdefault(r.unit_id, r.text) == r.text
    rows = status.collect()
    told = {(r.media_id, r.lang): (r.status, r.problem) for r in rows}
    assert len(told) == len(rows) and set(got) <= {k for k, v in told.items() if v[0] != "failed"}
    return got, told


def test_missing_and_damaged_are_asked_again_alone(spark):
    rules = {
        "de": lambda one, i, t: [] if i == 2 and not one else sound(one, i, t),
        "fr": lambda one, i, t: [(i, "\ufffd" if i == 5 and not one else f"<{t}>")],
        "it": lambda one, i, t: [(i, None if i == 6 and not one else f"<{t}>")],
        "es": lambda one, i, t: [] if i == 7 and "1 7" in t else sound(one, i, t),  # never, in media 1
        "ru": lambda one, i, t: [(i, " ")] if i == 1 and "2 1" in t else sound(one, i, t),
        "ja": lambda one, i, t: ([] if not one else [(i, "a"), (i, "b")]) if i == 3 else sound(one, i, t),
        "ko": lambda one, i, t: ([] if not one else [(i + 1, "other")]) if i == 3 else sound(one, i, t),
    }
    got, told = run(spark, {k: Script(v) for k, v in rules.items()})
    whole = {m: {u: f"<text {m} {u}>" for u in range(1, 8)} for m in (1, 2)}
    for m in (1, 2):
        for lang in ("de", "fr", "it"):
            assert got[m, lang] == whole[m] and told[m, lang] == ("translated", None)
        assert told[m, "ja"] == told[m, "ko"] == ("failed", "unknownId")
    assert told[1, "es"] == ("failed", "missing") and got[2, "es"] == whole[2]
    assert told[2, "ru"] == ("failed", "empty") and got[1, "ru"] == whole[1]


def test_ids_and_errors_fail_their_target_only(spark):
    def raises(pairs):
        if any("1 4" in t for _, t in pairs):
            raise OSError("gone")
        return [(i, t) for i, t in reversed(pairs)]  # the order is free

    got, told = run(spark, {
        "de": Script(lambda one, i, t: [*sound(one, i, t), *([(99, "x")] if t == "text 1 3" else [])]),
        "fr": Script(lambda one, i, t: [*sound(one, i, t), *([(1, "again")] if t == "text 2 7" else [])]),  # an id of an earlier batch
        "it": raises, "es": lambda pairs: ["no pairs"], "ru": Script(sound), "ko": lambda pairs: [("x", "y")], "ja": lambda pairs: None,
    })
    assert told[1, "de"] == ("failed", "unknownId") and told[2, "de"][0] == "translated"
    assert told[2, "fr"] == ("failed", "repeatedId") and told[1, "fr"][0] == "translated"
    assert told[1, "it"] == ("failed", "OSError") and got[2, "it"] == {u: f"text 2 {u}" for u in range(1, 8)}
    assert {told[m, lang][0] for m in (1, 2) for lang in ("es", "ko", "ja")} == {"failed"} and told[1, "ru"] == told[2, "ru"] == ("translated", None)


def test_copies_and_odd_tables(spark):
    units = [*UNITS, (3, "de", 1, "gut"), (3, "de", 2, " "), (4, None, 1, None), (None, "en", 1, "lost")]
    targets = [(1, "en"), (1, "en"), (3, "de"), (3, "fr"), (4, "fr"), (4, None), (None, "fr"), (9, "fr"), (2, "xx")]
    got, told = run(spark, {"fr": Script(sound), "en": lambda pairs: pytest.fail("a copy asks nobody")}, units, targets)
    assert told == {(1, "en"): ("copied", None), (3, "de"): ("failed", "empty"), (3, "fr"): ("translated", None), (4, "fr"): ("translated", None), (2, "xx"): ("failed", "translationNotReady")}
    assert got[1, "en"] == {u: f"text 1 {u}" for u in range(1, 8)} and got[4, "fr"] == {1: "<>"} and got[3, "fr"] == {1: "<gut>", 2: "< >"}
    u = spark.createDataFrame([], "media_id long, lang string, unit_id long, text string")
    done, status = translate_targets(u, spark.createDataFrame([(1, "fr")], "media_id long, lang string"), {"fr": Script(sound)})
    assert done.count() == status.count() == 0


def test_calls_make_no_frame_each(spark):
    """A pandas frame for each call took some 2 ms, and each target has calls."""
    units = [(m, "en", u, f"t {m} {u}") for m in range(300) for u in range(m % 5 + 1)]
    rule = lambda one, i, t: [] if i % 2 and not one else sound(one, i, t)
    got, told = run(spark, {"de": Script(rule), "fr": Script(sound)}, units, [(m, x) for m in range(300) for x in ("de", "fr")], batch=2)
    # a call of one unit is alone whichever round it is of
    assert set(told.values()) == {("translated", None)} and got == {(m, x): {u: f"<t {m} {u}>" for u in range(m % 5 + 1)} for m in range(300) for x in ("de", "fr")}
    assert not hasattr(translation, "pd")
