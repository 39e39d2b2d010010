import pytest
from graphloom.llm.sentences import sentence_spans, sentences


def parts(text):
    return [text[a:b] for a, b in sentences(text)]


CASES = {
    "Dr. Ha met Mr. B. today. It rained!": ["Dr. Ha met Mr. B. today.", "It rained!"],
    "See Fig. 3 and p. 4. Done.": ["See Fig. 3 and p. 4.", "Done."],
    'She said: "Go. Now!" and left. OK?': ['She said: "Go. Now!" and left.', "OK?"],
    'The log said "no such layout." Then it ended.': ['The log said "no such layout."', "Then it ended."],
    "(A note.) Next (see Eq. 4.) goes on. End.": ["(A note.)", "Next (see Eq. 4.) goes on.", "End."],
    "It keeps 3.5 MB, v1.2.3. load_x() is off. Really?!": ["It keeps 3.5 MB, v1.2.3.", "load_x() is off.", "Really?!"],
    "Er kam z. B. am 3. März. „Gut?“, fragte er. Knoten usw. Ende.": ["Er kam z. B. am 3. März.", "„Gut?“, fragte er.", "Knoten usw.", "Ende."],
    "Qui ? « Ça va ? » dit-elle. Fin.": ["Qui ?", "« Ça va ? » dit-elle.", "Fin."],
    "La réplica de EE. UU. es lenta. ¡No! ¿Sí?": ["La réplica de EE. UU. es lenta.", "¡No!", "¿Sí?"],
    "Он хранит узлы и т. д. «Да?» — спросил он.": ["Он хранит узлы и т. д.", "«Да?» — спросил он."],
    "先做。“真的吗？”他问道。节点……都会。": ["先做。", "“真的吗？”他问道。", "节点……都会。"],
    "「動く？」と尋ねた。担当者は「確認しました。」索引を消す！": ["「動く？」と尋ねた。", "担当者は「確認しました。」", "索引を消す！"],
    '"되나요?"라고 물었다. 끝.': ['"되나요?"라고 물었다.', "끝."],
    "यह है। क्यों? डॉ. वेलमार ने देखा।": ["यह है।", "क्यों?", "डॉ. वेलमार ने देखा।"],
    "راجع د. هالفك أمس. «هل يعمل؟» سأل المراجع.": ["راجع د. هالفك أمس.", "«هل يعمل؟» سأل المراجع."],
    "Γιατί όχι; Ναι. Άγκιστρα κ.λπ. Τέλος.": ["Γιατί όχι;", "Ναι.", "Άγκιστρα κ.λπ.", "Τέλος."],
    "โมดูลอ่านไฟล์ กราฟลบโหนด": ["โมดูลอ่านไฟล์", "กราฟลบโหนด"],
    "# Head. Two\nText one. Two\nlines.\n\n```\na. B.\n\nc\n```\n- One. Two.\n- z\n": ["# Head. Two", "Text one.", "Two\nlines.", "```\na. B.\n\nc\n```", "- One.", "Two.", "- z"],
    'He said "stop. And left. Then': ['He said "stop.', "And left.", "Then"],
    "It differs by 22.6 s. Dr. Ha left. See s. 4. It took 3 s. a.b_c is on (s. o.). End.": ["It differs by 22.6 s.", "Dr. Ha left.", "See s. 4.", "It took 3 s.", "a.b_c is on (s. o.).", "End."],
    "- aa. B.\n  2. c\n  3. dd. E\n- f\n\ng\n2. h": ["- aa.", "B.", "2. c", "3. dd.", "E", "- f", "g\n2. h"],
    "Τι\u037e Ναι.": ["Τι\u037e", "Ναι."],
    "": [], "  \n\t ": [], ".": ["."], "no end": ["no end"], "```\nopen. Fence": ["```\nopen. Fence"],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert parts(text) == CASES[text]


def test_spans_are_ordered_and_cover(spark):
    text = "One. " * 20_000 + "最后。"
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, "🎉 A. B c.", 0)], "doc_id bigint, text string, start_pos int")
    rows = sorted(map(tuple, sentence_spans(df).collect()))
    assert len(rows) == 20_002 and len(set(rows)) == len(rows)
    assert [r for r in rows if r[0] == 4] == [(4, 0, 9)]
    assert sentence_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["let a = b; ", "(", "a. (", ")(", '"a ', "„“", "γ; ", ".”"])
def test_time_grows_with_length(part):
    import time

    def took(n):
        began = time.process_time()
        sentences(part * (n // len(part)))
        return time.process_time() - began

    assert took(400_000) < 20 * max(took(50_000), 0.02)
