"""Problem 4: defective answers."""

import numpy as np
import pytest

from coursemill.llm import answers as a

QUESTIONS = ["How does the gain of stage %d change when the supply voltage drops?", "怎样用示波器测量第%d级的静态工作点？"]
GOOD = ["The gain falls because the bias current of the transistor is smaller, and the rest of the circuit stays as it is at %d mA.", "先断开负载，再把示波器接到集电极，读出的电压约为%d V，误差主要来自探头。"]


def requests():
    rows = []
    for i in range(600):
        z = i % 2
        question, answer, defect = QUESTIONS[z] % i, GOOD[z] % i, None
        if i % 12 == 1:
            answer, defect = ["", " ", "略", "N/A", "Answer:", None, "。"][i % 7], "empty"
        elif i % 12 == 3:
            answer, defect = answer[: len(answer) // 2].rstrip(" ,，"), "truncated"
        elif i % 12 == 5:
            answer, defect = ["抱歉，我无法回答这个问题。", "Sorry, I can't help with that."][i % 2], "refusal"
        elif i % 12 == 7:
            answer, defect = question.upper() if not z else f"题目：{question}", "copies_question"
        elif i % 12 == 9:
            answer, defect = GOOD[1 - z] % i, "other_language"
        elif i % 12 == 11:
            answer = ["正确", "约 3 V", "抱歉，上一步写反了，更正如下。" + GOOD[1] % i, f"{question}\n答：{answer}", "所以 U = 3.2 mV"][i % 5]
        rows.append((i, None if i % 50 == 0 else "" if i % 3 == 0 else question, question, answer, defect))
    return rows


def test_defects_are_found(spark):
    rows = requests()
    df = spark.createDataFrame([r[:4] for r in rows + rows[:40]], "request_id long, question string, content string, answer string")
    got = {r.request_id: r.defect for r in a.find_defects(df).collect()}
    want = {r[0]: r[4] for r in rows if r[4]}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert len(set(got) - set(want)) <= 0.02 * len(want)


def test_edge_cases(spark):
    schema = "request_id long, question string, content string, answer string, defect string"
    assert a.find_defects(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, "x"), (2, "q?", None, "word " * 50_000 + "end.", "x"), (None, "q", "q", "", "x")], schema)
    assert {r.request_id: r.defect for r in a.find_defects(odd).collect()}.get(2) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("Die Spannung ist nicht konstant und der Strom wird größer.", "de"), ("La tension est mesurée avec le circuit et la charge.", "fr"), ("这里的电压保持不变，电流增大。", "zh"), ("まず出力電圧を測定します。", "ja"), ("Сначала измеряют входное сопротивление.", "ru"), ("B", ""), ("```\nR1 n1 n2 3k\n```", "")],
)
def test_language(text, want):
    assert a.language(text) == want


def test_label_model_recovers_the_truth():
    rng = np.random.default_rng(5)
    truth = rng.random(6000) < 0.15
    accuracy = [0.95, 0.85, 0.7]
    votes = np.stack([np.where(rng.random(6000) < q, np.where(truth, a.YES, a.NO), np.where(truth, a.NO, a.YES)) for q in accuracy], 1)
    votes[rng.random(votes.shape) < 0.2] = a.ABSTAIN
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = a.LabelModel(patterns, counts)
    chosen = model.posterior[back.ravel()] >= model.cutoff()
    assert 0.08 < model.prior[1] < 0.25
    assert (chosen == truth).mean() > 0.94


def test_codes_round_trip():
    for vote in ([0, 1, 2, 2], [2, 2, 0, 1, 1]):
        assert a.decode(a.encode(vote), len(vote)) == vote


def sound_pairs(rows):
    from coursemill.llm.canonical import canonical_string

    pairs = {r[0]: (canonical_string(r[1] if (r[1] or "").strip() else r[2] or ""), canonical_string(r[3] or "")) for r in rows}
    return [p for p in pairs.values() if a.sound(a.votes(*p)[0])]


@pytest.mark.parametrize("parts", [1, 7])
def test_cutoffs_come_from_all_sound_pairs(spark, monkeypatch, parts):
    rows = [(r[0] + 600 * k, r[1], f"{r[2]} ({k})", f"({k}) {r[3]}" if r[4] is None else r[3]) for k in range(4) for r in requests()]
    seen = []

    def cutoff(self, planted, planted_counts, clean, clean_counts):
        seen.append(({a.encode(list(p)): n for p, n in zip(planted, planted_counts)}, {a.encode(list(p)): n for p, n in zip(clean, clean_counts)}))
        return 0.5

    monkeypatch.setattr(a.LabelModel, "validated_cutoff", cutoff)
    df = spark.createDataFrame(rows + rows[:90], "request_id long, question string, content string, answer string")
    a.label_defects(df.repartition(parts))
    sound = sound_pairs(rows)
    assert len(sound) > 800 and len(seen) == len(a.DEFECTS)
    for defect, (planted, clean) in zip(a.DEFECTS, seen):
        want = {}
        for question, answer in sound:
            code = a.encode(a.votes(question, answer)[0][defect])
            want[code] = want.get(code, 0) + 1
        if defect == "truncated":  # without the vote on the last word, which looks at the whole table
            clean = {c: sum(n for k, n in clean.items() if k // 3 == c) for c in {k // 3 for k in clean}}
        assert clean == want
        share = {"truncated": sum(len(x) > a.LONG_ANSWER for _, x in sound), "other_language": sum(bool(a.language(q)) for q, _ in sound)}
        assert sum(planted.values()) == pytest.approx(share.get(defect, len(sound)))
    codes = {}
    for question, answer in sound:
        code, _ = a.cut_off(question, answer)
        codes[code] = codes.get(code, 0) + (code is not None)
    planted = seen[a.DEFECTS.index("truncated")][0]
    assert {c: sum(n for k, n in planted.items() if k // 3 == c) for c in {k // 3 for k in planted}} == {c: n for c, n in codes.items() if n}


def test_foreign_answers_are_all_pairs():
    asked = ["Why does the gain of the stage fall with the load?", "为什么输出电压会随着负载下降?", "请用英文回答:为什么输出电压会随着负载下降?", "Welche Spannung ist an dem Transistor und wird sie größer?", "x"]
    said = ["It falls because the load is in parallel with the resistor of the stage.", "因为负载与集电极电阻并联,输出电压下降。", "因为 the load and resistor 并联,输出电压下降了很多 gain", "Die Spannung ist nicht konstant und der Strom wird größer.", "正确"]
    want: dict[int, float] = {}
    for question in asked:
        known = a.asked(question)
        others = [x for x in said if known.language and a.language(x) and a.language(x) not in {known.language, *known.languages}]
        for answer in others:
            code = a.encode(a.vote_language(question, answer))
            want[code] = want.get(code, 0) + 1 / len(others)
    count = lambda codes: {c: codes.count(c) for c in codes}
    got = a.foreign_answers(count([a.asks_code(q) for q in asked]), count([a.speaks_code(x, a.language(x)) for x in said]))
    assert len(want) >= 2 and dict(got) == pytest.approx(want)


def test_validated_cutoff_weighs_by_counts():
    patterns = np.array([[a.YES, a.YES], [a.YES, a.NO], [a.NO, a.NO]])
    model = a.LabelModel(patterns, np.array([50, 30, 900]))
    model.prior, model.table = np.array([0.9, 0.1]), np.array([[[0.08, 0.02, 0.9], [0.08, 0.02, 0.9]], [[0.03, 0.95, 0.02], [0.03, 0.37, 0.6]]])
    half = model.predict(patterns)[1]
    few, many = (model.validated_cutoff(patterns[:2], np.array([95.0, 5.0]), patterns[1:], np.array([n, 900.0])) for n in (0.0, 400.0))
    assert half >= 0.5 and few <= half < many


def test_apart_misses_no_shared_half():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab电1"), rng.integers(0, 14))) for _ in range(600)]
    questions, answers = texts[:300], texts[300:]
    cover = [sum(g in set(a.grams(q)) for g in a.grams(x)) / max(1, len(x) - 3) for q, x in zip(questions, answers)]
    got = a.apart(questions, answers)
    assert any(got) and not any(d and c >= 0.5 for d, c in zip(got, cover))
    assert a.apart([""], [""]) == a.apart(["abc"], ["abc"]) == a.apart(["xabcdex"], ["abcde"]) == [False]
    assert all(a.vote_copy(q, x) == a.vote_copy(q, x, x, d) for q, x, d in zip(questions, answers, got))
