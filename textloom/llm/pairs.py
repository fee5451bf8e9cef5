"""Broken prompt and response pairs: empty, truncated, refused, copied and wrong-language responses.

Each pair is looked at on its own in one pass: a suffix automaton of the prompt's words is walked by the response to
measure how much of it is copied, an Aho-Corasick automaton finds refusals, stacks find delimiters left open, and
stopwords vote for a language. Only figures leave that pass. How long a response should be is learned from all pairs
(the median ratio of lengths for each pair of languages, at most languages squared rows), and defects are then named by
expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import boundaries as B
from textloom.tables import cut_lineage

# The function words of each language, most frequent first.
STOPWORDS = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their there we can her has all been if would who so no will what she do when my him them your me its our than then very just into about could after before between under while because these those where how does did here also only",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando esta ser son también fue había era muy hasta desde nos durante ni contra ese eso qué quien donde porque unos unas ellos él mi tu te les e está están antes después según",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha lhe está é são foi era há ser sobre sob antes durante onde este esta",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont ou avec son aux elle comme mais on nous vous je tu sa ses leur si cette été fait ces entre sans très l d qu n s c j y lui être tout où quand sous vers chez après avant pendant aussi donc était fut ont ni",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde unter zwischen gegen ohne seit wenn wer was wann wo kein keine ich du wir ihr ihre seine weil dieser diese dieses",
    "ru": "и в не на я что он с как это по но из у за же от так для мы к то вы бы о его её их она они оно мне меня нас вас ему ей под над при до без через между или если когда где кто ни ли был была были было есть со ко об уже ещё только также потому чтобы этот эта эти тот та",
}
# What a word says for a language: more, the more frequent it is there.
_VOTES: dict[str, list[tuple[str, float]]] = {}
for _lang, _words in STOPWORDS.items():
    for _rank, _w in enumerate(_words.split()):
        _VOTES.setdefault(_w, []).append((_lang, 25 / (25 + _rank)))
_VOTES = {_w: [(_lang, _weight / len(_hits) ** 0.5) for _lang, _weight in _hits] for _w, _hits in _VOTES.items()}
# Letters that only some of the languages use.
_LETTERS = {"ñ": ["es"], "¿": ["es"], "¡": ["es"], "ã": ["pt"], "õ": ["pt"], "ç": ["pt", "fr"], "ê": ["pt", "fr"], "è": ["fr"], "û": ["fr"], "î": ["fr"], "œ": ["fr"], "ß": ["de"], "ä": ["de"], "ö": ["de"], "ü": ["de"], "â": ["pt", "fr"], "à": ["pt", "fr"], "ù": ["fr"], "ô": ["pt", "fr"], "á": ["es", "pt"], "í": ["es", "pt"], "ó": ["es", "pt"], "ú": ["es", "pt"]}

# How inability or refusal is said, and what a service is asked to do, in lower case. Both in one sentence refuse.
CANNOT = {
    "en": ["cannot", "can't", "can not", "unable", "not able to", "won't", "will not", "couldn't", "could not", "not allowed", "not permitted", "not possible", "impossible to", "failed", "refuse", "decline", "against", "violate", "no answer", "no response", "not going to"],
    "es": ["no puedo", "no podemos", "no podré", "no pude", "no es posible", "no me es posible", "no se pudo", "no ha sido posible", "no sé", "no soy capaz", "no estoy en condiciones", "imposible", "me niego", "en contra de", "error al", "no puedes pedirme", "no me está permitido"],
    "pt": ["não posso", "não podemos", "não consigo", "não consegui", "não poderei", "não pude", "não é possível", "não foi possível", "não sei", "não sou capaz", "impossível", "recuso", "contra as", "não me é permitido", "erro ao"],
    "fr": ["ne peux pas", "ne peux malheureusement pas", "ne pouvons pas", "ne pourrai pas", "ne suis pas en mesure", "pas possible", "n'est pas possible", "n'ai pas pu", "ne sais pas", "incapable de", "impossible", "refuse de", "contraire à", "contre mes", "échec", "a échoué", "ne m'est pas permis"],
    "de": ["kann ich nicht", "kann ich leider nicht", "kann das nicht", "kann das leider nicht", "kann dies", "kann diesen", "kann dir", "kann ihnen", "kann leider nicht", "kann ich das nicht", "können wir nicht", "können wir leider nicht", "nicht in der lage", "nicht möglich", "konnte nicht", "konnten nicht", "leider nicht", "nicht erlaubt", "verstößt gegen", "gegen meine", "fehlgeschlagen", "lehne", "weigere"],
    "ru": ["не могу", "не можем", "не смогу", "не смог", "не удалось", "не получится", "не способ", "не в состоянии", "невозможно", "не имею возможности", "отказыва", "вынужден отказать", "противоречит", "нарушает", "не разрешено", "ошибка при"],
    "zh": ["无法", "不能", "不了", "不可以", "没办法", "没法", "拒绝", "不允许", "违反", "失败"],
    "ja": ["できません", "できない", "できかねます", "られません", "られない", "せません", "せない", "不可能", "お断り", "失敗", "違反", "しかねます"],
}
ASKED = {
    "en": ["translat", "help", "assist", "provide", "fulfil", "comply", "process", "respond", "answer", "request", "complete", "generate", "do that", "do this", "policy", "policies", "guideline", "content", "came"],
    "es": ["traduc", "traduzc", "ayudar", "asistir", "proporcionar", "ofrecer", "responder", "procesar", "cumplir", "completar", "hacer eso", "solicitud", "petición", "política", "normas", "contenido"],
    "pt": ["tradu", "ajudar", "auxiliar", "fornecer", "responder", "processar", "atender", "completar", "fazer isso", "solicitação", "pedido", "política", "diretrizes", "conteúdo"],
    "fr": ["tradui", "traduc", "aider", "assister", "fournir", "répondre", "traiter", "donner suite", "effectuer", "demande", "requête", "politique", "règles", "consignes", "contenu"],
    "de": ["übersetz", "helfen", "weiterhelfen", "unterstützen", "bereitstellen", "beantworten", "bearbeiten", "verarbeiten", "erfüllen", "liefern", "anfrage", "richtlinie", "inhalt"],
    "ru": ["перевести", "перевод", "переве", "помочь", "помощ", "предоставить", "ответить", "выполнить", "обработать", "запрос", "правил", "политик", "содержан"],
    "zh": ["翻译", "译", "帮助", "帮", "协助", "提供", "回答", "处理", "完成", "满足", "请求", "政策", "准则", "规定"],
    "ja": ["翻訳", "訳", "手伝い", "提供", "お答え", "回答", "対応", "応じ", "処理", "お力", "リクエスト", "ご要望", "ポリシー", "ガイドライン"],
}
# What only a service says.
SERVICE = [
    "as an ai", "as an assistant", "as a language model", "language model", "translation_failed", "i'm an ai", "i am an ai",
    "como asistente", "modelo de lenguaje", "como ia", "como assistente", "modelo de linguagem", "en tant qu'assistant", "en tant qu'ia", "modèle de langage",
    "als sprachmodell", "als ki", "als assistent", "языковая модель", "как ассистент", "как ии", "作为ai", "作为一个ai", "作为人工智能", "语言模型", "言語モデル", "aiとして", "aiアシスタント",
]

# Letters and digits of a response for each of an English text's, before anything is learned.
PRIOR = {"en": 1.0, "es": 1.02, "pt": 0.98, "fr": 1.02, "de": 1.03, "ru": 0.8, "zh": 0.29, "ja": 0.38}
PRIOR_WEIGHT = 20
#: Letters and digits of a prompt from which on its pair is learned from.
LEAST_LETTERS = 15
#: The share of a response from which on it is a copy.
COPIED = 0.9
# The share of a word's occurrences that close a sentence, before anything is learned, and the occurrences it counts as;
# and the share under which a text that stops at the word without an end mark breaks off there.
CLOSING_PRIOR, CLOSING_WEIGHT, CLOSING_SHARE = 0.08, 4, 0.15

_TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_぀-ヿ㐀-䶿一-鿿]+")
_ALNUM = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_LETTERS_RUN, _KANA, _HAN, _CYRILLIC = re.compile(r"[^\W\d_]+"), re.compile(r"[぀-ヿ]+"), re.compile(r"[㐀-䶿一-鿿]+"), re.compile(r"[а-яё]")
_NAME = re.compile(r"\d[\d.,:]*\Z|[A-Z][\w'’\-]*\Z|[A-Z0-9][A-Z0-9\-.]*\Z")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】"}
_MARKS = re.compile("[" + "".join(map(re.escape, sorted({*_PAIRS, *"".join(_PAIRS.values())}))) + "]")
# A point after a time of day, or after a number in a script without spaces, ends no sentence.
_UNFINISHED = re.compile(r"(?:\b[ap]\.\s?m|\bч|\benv|[\u3040-\u9fff][0-9]+)\.\Z")
#: Characters before a text's last point that its rules may look at.
_NEAR = 24
_END_MARK = re.compile(r"(?:[.!?。！？｡]+|…+)(?=[\s»”」』\"'’)\]）]|\Z|[\u3040-\u30ff\u3400-\u9fff“「『])")
_WORD_BEFORE = re.compile(r"[\w.]*\Z")
_FINISH = re.compile(r"([.!?。！？｡]+|…+|\.{3,})[\s»”」』\"'’“)\]）】]*\Z")


def _automaton() -> ahocorasick.Automaton:
    """All phrases, each with what it says: ``(language, whether it refuses)``, or None for what only a service says."""
    said: dict[str, list[tuple[str, bool] | None]] = {p: [None] for p in SERVICE}
    for refuses_, lists in ((True, CANNOT), (False, ASKED)):
        for lang, phrases in lists.items():
            for p in phrases:
                said.setdefault(p, []).append((lang, refuses_))
    a = ahocorasick.Automaton()
    for p, what in said.items():
        a.add_word(p, (len(p), what))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []
_SENTENCE_END = re.compile(r"[.!?。！？\n]")


def refuses(text: str) -> bool:
    """Whether a sentence of ``text`` says that something asked of a service isn't done, or ``text`` speaks as a service.

    A phrase counts from the start of a word on.
    """
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    low = text.lower().replace("’", "'")
    sentence, said = 0, set()
    for last, (n, whats) in _AUTOMATON[0].iter(low):
        begin = last - n + 1
        if begin and low[begin - 1].isalpha() and low[begin] < "\u3000":
            continue
        if sentence <= begin and _SENTENCE_END.search(low, sentence, begin):
            sentence = begin
            said.clear()
        for what in whats:
            if what is None:
                return True
            said.add(what)
            if (what[0], not what[1]) in said:
                return True
    return False


def vote(text: str) -> str | None:
    """The language that the script, the stopwords and the letters of ``text`` speak for; None if none leads."""
    low = text.lower()
    words = _LETTERS_RUN.findall(low)
    highest = max(low, default="")
    if highest >= "\u3040":
        kana, han = (sum(map(len, p.findall(low))) for p in (_KANA, _HAN))
        if kana + han > (sum(map(len, words)) - kana - han) / 2:
            return "ja" if kana * 8 > han else "zh"
    if highest >= "\u0400" and _CYRILLIC.search(low):
        return "ru"
    tally: dict[str, float] = {}
    for w in words:
        for k, weight in _VOTES.get(w, ()):
            tally[k] = tally.get(k, 0.0) + weight
    for c in set(low) & _LETTERS.keys() if highest > "\x7f" else ():
        for k in _LETTERS[c]:
            tally[k] = tally.get(k, 0.0) + 1.0
    ranked = sorted(tally.items(), key=lambda x: -x[1])
    return ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] > ranked[1][1]) else None


class SuffixAutomaton:
    """All runs of words of a prompt, in linear space."""

    def __init__(self, units: list[str]) -> None:
        self.to: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for u in units:
            cur = len(self.to)
            self.to.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and u not in self.to[p]:
                self.to[p][u] = cur
                p = self.link[p]
            if p >= 0:
                q = self.to[p][u]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.to)
                    self.to.append(dict(self.to[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.to[p].get(u) == q:
                        self.to[p][u] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def copied(self, units: list[str], least: int) -> int:
        """How many of ``units`` stand in runs of at least ``least`` that the prompt holds too."""
        state = length = covered = end = 0
        for i, u in enumerate(units, 1):
            while state and u not in self.to[state]:
                state = self.link[state]
                length = self.size[state]
            if u in self.to[state]:
                state = self.to[state][u]
                length += 1
            else:
                length = 0
            if length >= least:
                covered += i - max(end, i - length)
                end = i
        return covered


def copied_share(prompt: str, response: str) -> float:
    """The share of the longer of the two, in words, that the response copies from the prompt; 0 where it is under
    :data:`COPIED` for want of common words.

    A heading word before a colon isn't counted to the response.
    """
    p, r = _TOKEN.findall(prompt.casefold()), _TOKEN.findall(response.casefold())
    if not p or not r:
        return 0.0
    head, colon, rest = response.partition(":")
    if colon and len(_TOKEN.findall(head)) <= 3 and not prompt.lstrip().casefold().startswith(head.strip().casefold()):
        r = _TOKEN.findall(rest.casefold()) or r
    most = max(len(p), len(r))
    held = set(p)
    # Words that the prompt doesn't hold aren't copied: where too many are, the automaton would only say so again.
    if sum(w in held for w in r) < COPIED * most:
        return 0.0
    return SuffixAutomaton(p).copied(r, min(3, len(p))) / most


def open_delimiters(text: str) -> int:
    """How many quotations and brackets are left open."""
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        c = m[0]
        if stack and c in _PAIRS[stack[-1]]:
            stack.pop()
        elif c in _PAIRS:
            stack.append(c)
    return len(stack)


def finish(text: str) -> str:
    """How a text ends: ``mark``, ``dots``, ``open`` (a comma or the like) or ``none`` (also after an abbreviation, or with
    a delimiter left open)."""
    m = _FINISH.search(text.rstrip())
    if not m or open_delimiters(text):
        return "open" if text.rstrip()[-1:] in tuple(",;:，、；：-–—(“„«「") else "none"
    if m[1][0] == "…" or m[1].startswith("..."):
        return "dots"
    if m[1] == ".":
        # A point's rules look at the words around it, so the last words of the text say all.
        begin = max(0, m.start(1) - _NEAR)
        while begin and not text[begin - 1].isspace() and begin > m.start(1) - 4 * _NEAR:
            begin -= 1
        ends = [e for e in B.scan_events(text[begin:].rstrip(), False) if e[1] in (B.S_PLAIN, B.S_MAYBE, B.S_NUMBER, B.S_FIRST_NUMBER)]
        if not ends or begin + ends[-1][0] < m.end(1) or _UNFINISHED.search(text[begin : m.end(1)]):
            return "none"
    return "mark"


def end_marks(text: str) -> list[int]:
    """Where the marks that end a sentence stand, abbreviations and initials left out: counts to compare, not boundaries."""
    out = []
    for m in _END_MARK.finditer(text):
        if m[0] == ".":
            word = _WORD_BEFORE.search(text, max(0, m.start() - _NEAR), m.start())[0].lower().strip(".")
            if word in B.NEVER or word in B.MAYBE or len(word) == 1 and word < "\u3000":
                continue
        out.append(m.start())
    return out


def _stretches(text: str, ends: list[int]) -> int:
    """How many stretches of words the marks part a text into, one without a mark at its end included."""
    return len(ends) + (_ALNUM.search(text, ends[-1] if ends else 0) is not None)


def _lowered(text: str) -> str:
    """``text`` in lower case, as many characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def ending_units(low: str) -> list[str]:
    """The words of a text in lower case; in scripts without spaces a character with the word before it."""
    tokens = _TOKEN.findall(low)
    return [b + w if len(w) == 1 and w > "\u3000" else w for b, w in zip(["", *tokens], tokens, strict=False)]


def closing_words(text: str, ends: list[int], marked: bool) -> tuple[list[str], list[str]]:
    """All words of a text, and those that close a sentence there, before one of the marks at ``ends``.

    What closes the last sentence of a text without an end mark isn't known, and its last word isn't among the first.
    """
    low = _lowered(text)
    closed: list[str] = []
    if low.isascii() or not _CJK.search(low):
        words = _ALNUM.findall(low)
        for e in ends:
            k = e
            while k and not low[k - 1].isalnum():
                k -= 1
            i = k
            while i and low[i - 1].isalnum():
                i -= 1
            if i < k:
                closed.append(low[i:k])
    else:
        words = ending_units(low)
        for e in ends:
            closed += ending_units(low[max(0, e - 64) : e])[-1:]
    return (words if marked else words[:-1]), closed


def last_word(text: str) -> str | None:
    """The last of :func:`ending_units`."""
    low = _lowered(text)
    k = len(low)
    while k and not low[k - 1].isalnum():
        k -= 1
    units = ending_units(low[max(0, k - 200) : k])
    return units[-1] if units else None


def invariant(text: str) -> bool:
    """Whether a text is the same in every language: up to three numbers, names or codes."""
    found = 0
    for w in text.split():
        if w := w.strip("“”„«»\"'().,!?;:&"):
            found += 1
            if found > 3 or not _NAME.match(w) or w.lower() in _VOTES:
                return False
    return found > 0


_FIGURES = "pair_key long, target string, prompt_n int, response_n int, prompt_lang string, response_lang string, fixed boolean, refusal boolean, copied double, finish string, last string, prompt_ends int, response_ends int, words array<struct<target:string,word:string,seen:long,closed:long>>"


def _figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        seen: dict[str, Counter[str]] = {}
        closed: dict[str, Counter[str]] = {}
        for key, prompt, response, target in zip(batch["k"], batch["p"], batch["r"], batch["t"], strict=True):
            prompt, response = prompt or "", response or ""
            pn, rn = sum(map(len, _ALNUM.findall(prompt))), sum(map(len, _ALNUM.findall(response)))
            if not pn or not rn:
                rows.append((key, target, pn, rn, None, None, invariant(prompt), False, 0.0, "none", None, 0, 0, None))
                continue
            lang, refusal, how, ends = vote(response), refuses(response) and not refuses(prompt), finish(response), end_marks(response)
            if lang == target and not refusal and pn >= LEAST_LETTERS:
                words, closing = closing_words(response, ends, how == "mark")
                seen.setdefault(target, Counter()).update(words)
                closed.setdefault(target, Counter()).update(closing)
            # Where a text ends in a mark its last word decides nothing.
            last = None if how == "mark" else last_word(response)
            rows.append((key, target, pn, rn, vote(prompt), lang, invariant(prompt), refusal, copied_share(prompt, response), how, last, _stretches(prompt, end_marks(prompt)), _stretches(response, ends), None))
        if rows:
            # The words of the whole batch stand in its first row.
            rows[0] = (*rows[0][:-1], [{"target": t, "word": w, "seen": n, "closed": closed[t][w]} for t, own in seen.items() for w, n in own.items()])
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FIGURES.split(", ")])


def pair_figures(df: DataFrame, key: str, prompt: str, response: str, target: str) -> DataFrame:
    """What is measured of each pair, as :data:`_FIGURES`; nulls count as empty texts, rows without a key are left out."""
    lang = F.lower(F.regexp_extract(F.coalesce(F.col(target), F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(prompt).alias("p"), F.col(response).alias("r"), lang.alias("t")).mapInPandas(_figures, _FIGURES)


def broken_pairs(df: DataFrame, key: str, prompt: str, response: str, target: str) -> DataFrame:
    """``pair_key, defect``: each broken pair once, with the first of ``empty, refusal, copy, wrong_language, truncated``
    that holds.

    A prompt without a letter or digit, or of names, numbers and codes only, makes no broken pair. A null ``target``
    makes no wrong language. Rows stored twice are judged each.
    """
    figures = cut_lineage(pair_figures(df, key, prompt, response, target))
    prior = F.create_map(*[F.lit(x) for kv in PRIOR.items() for x in kv])
    ratio = F.try_divide(F.col("response_n"), F.col("prompt_n"))
    base = F.coalesce(F.element_at(prior, F.col("target")) / F.element_at(prior, F.col("prompt_lang")), F.lit(1.0))
    fit = F.col("response_lang").eqNullSafe(F.col("target")) & ~F.col("refusal") & (F.col("prompt_n") >= LEAST_LETTERS)
    learned = figures.where(fit).groupBy("prompt_lang", "target").agg(F.percentile_approx(ratio, 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("pairs"))
    learned = learned.select(F.col("prompt_lang").alias("pl"), F.col("target").alias("tl"), "median", "pairs").where(F.col("pl").isNotNull())
    # At most one row for each pair of languages.
    # How often a word closes a sentence where it stands: a text without an end mark that stops at one that seldom does breaks off there.
    closings = figures.select(F.inline("words")).groupBy(F.col("target").alias("ft"), F.col("word").alias("fl")).agg(F.sum("seen").alias("seen"), F.sum("closed").alias("closed"))
    figures = figures.drop("words").join(closings, (F.col("target") == F.col("ft")) & (F.col("last") == F.col("fl")), "left")
    judged = figures.join(F.broadcast(learned), (F.col("prompt_lang") == F.col("pl")) & (F.col("target") == F.col("tl")), "left")
    n = F.coalesce("pairs", F.lit(0))
    usual = (n * F.coalesce("median", F.lit(0.0)) + PRIOR_WEIGHT * base) / (n + PRIOR_WEIGHT)
    share = F.try_divide(ratio, usual)
    fewer = F.col("response_ends") < F.col("prompt_ends")
    closing = (F.coalesce("closed", F.lit(0)) + CLOSING_WEIGHT * CLOSING_PRIOR) / (F.coalesce("seen", F.lit(0)) + CLOSING_WEIGHT)
    dangling = (closing < CLOSING_SHARE) | (F.col("finish") == "open")
    # What lacks a third is truncated; shares are estimates, so what is seen to break off may lack a little less by them.
    lacks = share < F.when((F.col("finish") != "mark") & dangling, 0.81).when(fewer, 0.72).otherwise(2 / 3)
    defect = (
        F.when(F.col("fixed") | (F.col("prompt_n") == 0), None)
        .when(F.col("response_n") == 0, "empty")
        .when(F.col("refusal"), "refusal")
        .when((F.col("copied") >= COPIED) & ~F.col("prompt_lang").eqNullSafe(F.col("target")), "copy")
        .when(F.col("response_lang").isNotNull() & (F.col("target") != "") & (F.col("response_lang") != F.col("target")) & ~F.col("response_lang").eqNullSafe(F.col("prompt_lang")), "wrong_language")
        .when((F.col("response_lang").isNull() | (F.col("response_lang") == F.col("target"))) & lacks, "truncated")
    )
    return judged.select("pair_key", defect.alias("defect")).where(F.col("defect").isNotNull())
