from __future__ import annotations

import random

from tests.conftest import rows
from textloom.llm import pairs
from textloom.llm.pairs import SuffixAutomaton, broken_pairs, copied_share, finish, invariant, open_delimiters, refuses, vote

EN = "The gardener opened the wooden box near the harbour. The miller lost the key in the garden."
DE = "Die Gärtnerin öffnete die Holzkiste am Hafen. Die Müllerin verlor das Schlüsselchen im Garten."


def test_suffix_automaton_is_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        a = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
        b = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
        least = rnd.randrange(1, 4)
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + least, len(a) + 1)}
        covered = {k for i in range(len(b)) for j in range(i + least, len(b) + 1) if tuple(b[i:j]) in runs for k in range(i, j)}
        assert SuffixAutomaton(a).copied(b, least) == len(covered)


def test_parts():
    assert copied_share(EN, EN.upper()) == 1.0 and copied_share(EN, "Translation: " + EN + "  ") == 1.0 and copied_share(EN, DE) < 0.2
    assert [vote(x) for x in (EN, DE, "他走了", "彼は行った", "Он ушёл", "La vecina perdió el pan", "A vizinha perdeu o pão", "Le voisin perdit le pain", "x", "")] == ["en", "de", "zh", "ja", "ru", "es", "pt", "fr", None, None]
    assert refuses("Lo siento, no puedo traducir este texto.") and refuses("[TRANSLATION_FAILED] x") and not refuses(DE)
    assert all(map(invariant, ("12:30", "A-17", "OK.", "“Kalbrin”", "Torrik & Ossner", "3.141"))) and not any(map(invariant, (EN, "", "the", "Wait for the man")))
    assert [finish(x) for x in ("Ana.", "Ana…", "Ana", "Siehe S.", "«Подожди!", "Oh no!”")] == ["mark", "dots", "none", "none", "none", "mark"]
    assert open_delimiters("(a [b) “c”") == 3 - 1 or open_delimiters("(a [b]) “c”") == 0


def test_broken_pairs(spark):
    good = [(i, f"The gardener opened the wooden box number {i} near the harbour.", f"Die Gärtnerin öffnete die Holzkiste Nummer {i} am alten Hafen.", "de") for i in range(100, 160)]
    cases = [
        (1, EN, DE, "de", None), (2, EN, "", "de", "empty"), (3, EN, None, "de", "empty"), (4, EN, "…", "de", "empty"), (5, EN, "Als Sprachmodell kann ich das nicht übersetzen.", "de", "refusal"),
        (6, EN, EN.lower().rstrip("."), "de", "copy"), (7, EN, "Translation: " + EN, "de", "copy"), (8, EN, "Le jardinier ouvrit la boîte en bois près du port, et le meunier perdit la clé.", "de", "wrong_language"),
        (9, EN, "Die Gärtnerin öffnete die", "de", "truncated"), (10, EN, "Die Gärtnerin öffnete die Holzkiste am Hafen.", "de", "truncated"), (11, EN, DE.rstrip("."), "de", None), (12, "12:30", "12:30", "de", None),
        (13, "", "", "de", None), (14, None, None, "de", None), (15, "I cannot translate this, said the captain.", "Das kann ich nicht übersetzen, sagte die Kapitänin.", "de", None), (16, EN, EN, None, "copy"), (17, "Velm", "", "de", None), (2, EN, "", "de", "empty"),
    ]
    df = spark.createDataFrame(good + [c[:4] for c in cases], "k long, p string, r string, t string").selectExpr("*", "'x' AS defect", "1 AS target")
    got = rows(broken_pairs(df, "k", "p", "r", "t"))
    assert got == sorted(((c[0], c[4]) for c in cases if c[4]), key=repr)
    assert rows(broken_pairs(df.limit(0), "k", "p", "r", "t")) == []


def test_truncated_is_the_same_at_every_size(spark):
    """What stops in the middle is truncated in rare pairs of languages, and where one sentence ends with its last word."""
    whole = "Die Gärtnerin öffnete die Holzkiste Nummer {} am alten Hafen."
    for n in (20, 150):
        good = [(i, f"The gardener opened the wooden box number {i} near the harbour.", whole.format(i), "de") for i in range(100, 100 + n)]
        odd = (1, "The gardener opened the wooden box number 7 near the harbour.", "Die Gärtnerin öffnete die Holzkiste Nummer 7 alten Hafen am.", "de")
        cut = (2, odd[1], "Die Gärtnerin öffnete die Holzkiste am", "de")  # lacks about three in ten letters
        unmarked = (3, odd[1], "Gärtnerin öffnete Holzkiste, alten Hafen", "de")  # as short, stops at a word that ends sentences
        df = spark.createDataFrame([*good, odd, cut, unmarked], "k long, p string, r string, t string")
        assert rows(broken_pairs(df, "k", "p", "r", "t")) == [(2, "truncated")]
        assert rows(broken_pairs(df.where("k != 1"), "k", "p", "r", "t")) == [(2, "truncated")]


def test_a_third_less_is_truncated(spark):
    good = [(i, f"The gardener opened the wooden box number {i} near the harbour.", f"Die Gärtnerin öffnete die Holzkiste Nummer {i} am alten Hafen.", "de") for i in range(100, 160)]
    short = [(1, good[0][1], "Sie öffnete die Kiste Nummer 100 am alten Hafen", "de"), (2, good[0][1], "Sie öffnete die Kiste Nr 100 am Hafen.", "de")]
    df = spark.createDataFrame([*good, *short], "k long, p string, r string, t string")
    assert rows(broken_pairs(df, "k", "p", "r", "t")) == [(2, "truncated")]


def test_closings_are_counted():
    found = [pairs.closing_words(t, pairs.end_marks(t), marked) for t, marked in (("Er ging heim. Sie ging", False), ("Er “ging”.", True), ("他走了。他走", False))]
    assert found == [(["er", "ging", "heim", "sie"], ["heim"]), (["er", "ging"], ["ging"]), (["他", "他走", "走了", "了他"], ["走了"])]
    assert [pairs.last_word(t) for t in ("Er GING. ", "", "…", "他走了", "x" * 300)] == ["ging", None, None, "走了", "x" * 200]


def test_lists_are_lower_case():
    phrases = [p for lists in (pairs.CANNOT, pairs.ASKED) for own in lists.values() for p in own] + pairs.SERVICE
    assert all(p == p.lower() for p in phrases)


# Ordinary sentences in eight languages, none of them like the test tables'.
PARALLEL = [
    {"en": "The committee will publish the results of the survey next month, but the members have not agreed on the budget.", "es": "El comité publicará los resultados de la encuesta el próximo mes, pero los miembros no se han puesto de acuerdo sobre el presupuesto.", "pt": "O comitê vai publicar os resultados da pesquisa no próximo mês, mas os membros não chegaram a um acordo sobre o orçamento.", "fr": "Le comité publiera les résultats de l'enquête le mois prochain, mais les membres ne se sont pas mis d'accord sur le budget.", "de": "Der Ausschuss wird die Ergebnisse der Umfrage im nächsten Monat veröffentlichen, aber die Mitglieder haben sich nicht auf das Budget geeinigt.", "ru": "Комитет опубликует результаты опроса в следующем месяце, но члены комитета не договорились о бюджете.", "zh": "委员会将在下个月公布调查结果，但成员们还没有就预算达成一致。", "ja": "委員会は来月に調査の結果を公表しますが、委員たちは予算についてまだ合意していません。"},
    {"en": "My sister works in a hospital and she often comes home late because the trains are slow.", "es": "Mi hermana trabaja en un hospital y a menudo llega tarde a casa porque los trenes son lentos.", "pt": "Minha irmã trabalha em um hospital e muitas vezes chega tarde em casa porque os trens são lentos.", "fr": "Ma sœur travaille dans un hôpital et elle rentre souvent tard à la maison parce que les trains sont lents.", "de": "Meine Schwester arbeitet in einem Krankenhaus und kommt oft spät nach Hause, weil die Züge langsam sind.", "ru": "Моя сестра работает в больнице и часто приходит домой поздно, потому что поезда ходят медленно.", "zh": "我的姐姐在医院工作，因为火车很慢，她经常很晚才回家。", "ja": "私の姉は病院で働いていて、電車が遅いのでよく遅く家に帰ります。"},
    {"en": "If you want to learn a language, you should read every day and speak with people who use it.", "es": "Si quieres aprender un idioma, debes leer todos los días y hablar con la gente que lo usa.", "pt": "Se você quer aprender uma língua, deve ler todos os dias e falar com as pessoas que a usam.", "fr": "Si vous voulez apprendre une langue, vous devriez lire tous les jours et parler avec les gens qui l'utilisent.", "de": "Wenn du eine Sprache lernen willst, solltest du jeden Tag lesen und mit den Menschen sprechen, die sie benutzen.", "ru": "Если вы хотите выучить язык, вам надо читать каждый день и говорить с людьми, которые на нём говорят.", "zh": "如果你想学习一门语言，就应该每天阅读，并和使用这门语言的人交谈。", "ja": "言語を学びたいなら、毎日読んで、その言語を使う人たちと話すべきです。"},
    {"en": "The new bridge was opened in 1987. It carries more than forty thousand cars a day.", "es": "El nuevo puente se abrió en 1987. Por él pasan más de cuarenta mil coches al día.", "pt": "A nova ponte foi aberta em 1987. Por ela passam mais de quarenta mil carros por dia.", "fr": "Le nouveau pont a été ouvert en 1987. Plus de quarante mille voitures y passent par jour.", "de": "Die neue Brücke wurde 1987 eröffnet. Mehr als vierzigtausend Autos fahren jeden Tag darüber.", "ru": "Новый мост был открыт в 1987 году. По нему проезжает более сорока тысяч машин в день.", "zh": "新桥于1987年通车。每天有四万多辆汽车从桥上经过。", "ja": "新しい橋は1987年に開通しました。毎日四万台以上の車が通ります。"},
]
REFUSED = {
    "en": ["I won't be able to provide that.", "I'm sorry, that request goes against policy.", "Sorry, I can't help with this one.", "Unfortunately I am not able to complete this request.", "The translation failed because of an error."],
    "es": ["Lo siento, pero no me es posible ayudarte con eso.", "No puedo responder a esta solicitud.", "Esa petición va en contra de nuestras normas.", "No se pudo procesar la traducción."],
    "pt": ["Desculpe, não consigo ajudar com esse pedido.", "Infelizmente não é possível traduzir este trecho.", "Não posso fornecer esse conteúdo."],
    "fr": ["Désolé, je ne suis pas en mesure de répondre à cette demande.", "Il m'est impossible de traduire ce passage.", "La traduction a échoué."],
    "de": ["Es tut mir leid, dabei kann ich leider nicht weiterhelfen.", "Diese Anfrage verstößt gegen die Richtlinien.", "Ich bin nicht in der Lage, diesen Text zu übersetzen."],
    "ru": ["Извините, я не смогу выполнить этот запрос.", "К сожалению, не удалось обработать текст: перевод недоступен.", "Я не могу с этим помочь."],
    "zh": ["抱歉，我不能协助完成这个请求。", "很遗憾，无法提供该内容的翻译。"],
    "ja": ["申し訳ありませんが、そのご要望にはお応えできません。", "この文章は翻訳できませんでした。"],
}


def held_out():
    """``prompt, response, target, defect`` of every kind, from the sentences above."""
    rnd = random.Random(9)
    out = []
    for n, row in enumerate(PARALLEL):
        for a in row:
            for b in row:
                if a == b:
                    continue
                p, r = row[a], row[b]
                out.append((p, r, b, None))
                out.append((p, r.rstrip(".。"), b, None))
                if n < 2:
                    out.append((p, rnd.choice(["", " ", "…", "—"]), b, "empty"))
                    out.append((p, p.upper() if rnd.random() < 0.5 else p.rstrip(".。"), b, "copy"))
                    other = rnd.choice([x for x in row if x not in (a, b)])
                    out.append((p, row[other], b, "wrong_language"))
                cut = r[: int(len(r) * rnd.uniform(0.3, 0.6))]
                out.append((p, cut.rstrip() if b in ("zh", "ja") else cut.rsplit(" ", 1)[0], b, "truncated"))
    out += [(PARALLEL[i % 4]["en" if b != "en" else "de"], r, b, "refusal") for b, own in REFUSED.items() for i, r in enumerate(own)]
    out += [(PARALLEL[i % 4]["fr"], r, "de", "refusal") for i, r in enumerate(REFUSED["en"])]
    # What people say in a text that is translated is no refusal.
    out += [("I cannot help you with the translation, she said.", "Ich kann dir bei der Übersetzung nicht helfen, sagte sie.", "de", None), ("Он не может ответить.", "No puede responder.", "es", None), ("They could not come to the garden.", "Sie konnten nicht in den Garten kommen.", "de", None)]
    return out


def test_held_out_sentences(spark):
    cases = held_out()
    df = spark.createDataFrame([(i, p, r, t) for i, (p, r, t, _) in enumerate(cases)], "k long, p string, r string, t string")
    got = dict(rows(broken_pairs(df, "k", "p", "r", "t")))
    for defect in ("empty", "truncated", "refusal", "copy", "wrong_language"):
        true, found = {i for i, c in enumerate(cases) if c[3] == defect}, {i for i, d in got.items() if d == defect}
        assert len(true) > 20
        for share in (len(true & found) / len(true), len(true & found) / max(1, len(found))):
            assert share >= 0.9, (defect, share, [cases[i] + (got.get(i),) for i in true ^ found][:8])
