"""Problem 4: defective answers of question-answer and prompt-response pairs, each with its kind of defect.

The collection adds to what one pair shows. All distinct responses, without marks, citations and labels, are sorted, and one
that is a proper prefix of a later one and ends inside a sentence of it is a shortened version. Response lengths at which
unfinished texts pile up, and beyond which there are fewer texts than that, are length limits, and unfinished texts of such
a length are cut. The words that tell the languages apart are learned from all responses, starting from function words.
Rules then look at each pair: empty, copy, refusal, other_language, and texts that break off. ``evidence`` counts what each
source of evidence found: where the longer version of a cut text isn't in the collection, only the text itself can show it.

Defined results: a null or blank text is ``empty`` (a null question too, then only empty, refusal and truncated are told);
at most one defect per text, in the order empty, copy, refusal, other_language, truncated; repeated rows count once; texts are
read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.storage import materialize

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿᠎]")
_CITE = re.compile(r"\[\s*(?:clue|sen|doc|source|ref)\b[^\[\]]*\]", re.I)
_MARKUP = re.compile(r"<[^<>\n]{0,200}>|&[a-z]{2,8};|&#\d+;|```\w*|[*_`#>~|]+", re.I)
_LABEL = re.compile(r"^\W*(?:answer|final answer|response|reply|question|you asked|the question was|a|q|antwort|frage|réponse|question|respuesta|pregunta|答案|回答|问题|问|答)\s*[:：]\s*", re.I)
_NOTHING = re.compile(r"^\W*(?:nan|none|null|nil|n\s*/\s*a|na|tbd|tba|todo|undefined|unknown|empty|no answer|not available|keine|aucune|ninguna|无|暂无)?\W*$", re.I)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\n+")
_HAN = re.compile(r"[㐀-鿿]")

#: ways to decline, each with what any match of it holds, so that most sentences need no search
_REFUSALS = [
    (lits, re.compile(way))
    for lits, way in (
        (("can", "could", "won", "able"), r"\b(?:can(?:'|’)?t|cannot|could not|couldn(?:'|’)t|won(?:'|’)t be able to|unable to|not able to) (?:help|assist|answer|respond|provide|comment|discuss|give|say|tell|offer|share|do that|fulfil)"),
        (("decline", "refuse"), r"\b(?:must|have to|need to) (?:decline|refuse)\b"),
        (("decline",), r"\bdecline to (?:answer|comment|respond|help)"),
        (("rather not",), r"\brather not (?:answer|comment|say|discuss)"),
        (("have",), r"\b(?:don(?:'|’)t|do not) have (?:enough|any|sufficient|the) (?:information|data|context|details)"),
        (("know", "have no"), r"\b(?:i )?(?:have no way of knowing|don(?:'|’)t know|do not know|have no (?:information|knowledge|idea))"),
        (("beyond what i",), r"\bbeyond what i (?:can|may)\b"),
        (("source", "document", "text", "passage"), r"\b(?:sources?|documents?|texts?|context|passages?)\b.{0,40}\b(?:silent|(?:do|does) ?n(?:o|')t (?:say|mention|contain|tell|state)|say nothing|says nothing)"),
        (("nothing in",), r"\bnothing in (?:the|my)\b.{0,40}\b(?:answer|respond|tell)"),
        (("possible for me",), r"\b(?:isn(?:'|’)t|not) possible for me\b"),
        (("no evidence in",), r"\bno evidence in\b.{0,40}\bno answer\b"),
        (("no answer can",), r"\bno answer can be given\b"),
        (("nicht",), r"\b(?:kann|darf|möchte) (?:ich|dazu|dabei)\b.{0,40}\bnicht\b.{0,20}\b(?:beantworten|helfen|sagen|antworten)?"),
        (("dabei", "liegen", "keine"), r"\bdabei darf ich nicht\b|\bliegen mir keine\b|\bkeine (?:angaben|informationen)\b"),
        (("peux", "puis", "suis"), r"\b(?:ne|n')\s?(?:peux|puis|suis)\b.{0,40}\b(?:pas|répondre|aider)\b"),
        (("disent rien",), r"\bn(?:'|’)en disent rien\b|\bne disent rien\b"),
        (("no puedo", "no podemos", "no me es"), r"\bno (?:puedo|podemos|me es posible)\b.{0,40}\b(?:responder|ayudar|contestar|decir)"),
        (("no dicen nada", "no tengo"), r"\bno dicen nada\b|\bno tengo (?:información|datos)\b"),
        (("无法", "不能", "不便", "没办法", "帮不了", "没有相关"), r"(?:无法|不能|不便|没办法)(?:回答|作答|提供|帮)|帮不了|没有相关(?:内容|信息|资料)|不能作答"),
    )
]
_FILLER = re.compile(
    r"^\W*(?:(?:i(?:'|’)?m |i am |so |very )?sorry\b|apolog|regrettabl|unfortunatel|hmm\b|thank|try (?:a|another)|i hope you|hope (?:this|you)|consult\b|please\b|is there (?:something|anything) else|feel free|let me know"
    r"|tut mir leid|es tut mir|leider\b|entschuldig|bitte\b|désolé|malheureusement|veuillez|lo siento|lamentablemente|por favor|disculp|抱歉|对不起|很遗憾|请)"
)

# fixed values: function words (articles, pronouns, prepositions, conjunctions, auxiliaries, question words) of each language
_WORDS = {
    "en": "the a an of and or is are was were be been by which from has have had with as that this these those they them their it its he she his her we you your i what who how when where why does do did can could would should may might must will under between for only because both while to cannot not no after before within if than then there here yes on at in into about over all any each more most other some such but so up out until since once already though although whether yet",
    "de": "der die das den dem des ein eine einen einer einem eines und oder aber nicht kein keine mit von vom zu zum zur im in am an auf aus bei nach vor über unter durch für gegen ohne um bis seit wenn weil dass ob als wie wer was wann wo warum welche welcher welches welchen wird werden wurde ist sind war hat haben hatte kann können darf muss soll er sie es wir ihr ihn ihm ihnen sich nur noch schon auch sehr so dann doch jedoch sondern damit sofern sobald",
    "fr": "le la les l un une des du de d au aux et ou mais ne pas plus que qui quoi dont où quand comment pourquoi quel quelle quels quelles combien est sont était été être a ont avait avoir peut peuvent doit ce cet cette ces il elle ils elles on nous vous je se sa son ses leur leurs y en dans par pour sur sous avec sans entre vers chez dès depuis avant après pendant car si comme puis donc aussi déjà encore ceux celle celui",
    "es": "el la los las un una unos unas de del al a y o u e pero no ni que quien quién qué cuándo cómo dónde por porque para con sin sobre entre hasta desde hacia en es son era fue ser está están estar ha han había puede pueden debe se su sus lo le les me te nos esta este estas estos ese esa eso esto como cuando donde si ya muy más menos también tras según antes después cuánto cuántos cuál cuáles pues aunque mientras",
}
_INDEX: dict[str, frozenset[str]] = {}
for _k, _v in _WORDS.items():
    for _w in _v.split():
        _INDEX[_w] = _INDEX.get(_w, frozenset()) | {_k}


def _votes(words: list[str], index: dict[str, frozenset[str]]) -> dict[str, float]:
    v = {k: 0.0 for k in _WORDS}
    for w in words:
        if w in index:
            share = index[w]
            for k in share:
                v[k] += 1 / len(share)
    return v


def _clean(t: str) -> str:
    return t if t.isascii() else _INVISIBLE.sub("", t).replace("\xa0", " ")


def _plain(t: str) -> str:
    t = _CITE.sub(" ", _clean(t))
    t = _MARKUP.sub(" ", t)
    while (m := _LABEL.match(t)) and m.end():
        t = t[m.end() :]
    return t.strip()


class Text:
    """One text, cleaned and taken apart once."""

    __slots__ = ("raw", "plain", "words", "lang", "votes")

    def __init__(self, raw: str, index: dict[str, frozenset[str]] = _INDEX):
        self.raw = raw
        self.plain = _plain(raw)
        self.words = _WORD.findall(self.plain.lower())
        v = _votes(self.words, index)
        v["zh"] = 0.0 if self.plain.isascii() else len(_HAN.findall(self.plain)) / 1.5
        a, b = sorted(v.values())[-2:][::-1]
        self.votes = v
        self.lang = max(v, key=v.get) if a >= 2 and a >= 1.5 * b else None  # what most function words or Han characters speak for


def is_empty(t: Text | None) -> bool:
    return t is None or (len(t.plain) < 40 or not t.words) and bool(_NOTHING.match(t.plain))


def declines(sentence: str) -> bool:
    return any(any(x in sentence for x in lits) and way.search(sentence) for lits, way in _REFUSALS)


def is_refusal(t: Text) -> bool:
    """Every sentence declines, or is a polite filler, and at least one declines."""
    found = False
    rest = t.plain.lower()
    while rest:
        parts = _SENTENCE.split(rest, maxsplit=1)
        s, rest = parts[0], parts[1] if len(parts) > 1 else ""
        words = _WORD.findall(s)
        if not words:
            continue
        if declines(s):
            found = True
        elif len(words) > 12 or not _FILLER.match(s):
            return False
    return found


def is_copy(t: Text, q: Text) -> bool:
    """Most words of the question and none beyond it."""
    if not q.words or not t.words or len(t.words) < 3 and _HAN.search(t.plain) is None:
        return False
    asked = set(q.words)
    if t.words[-1] not in asked:
        return False
    words = set(t.words)
    if len(words - asked) > 2:  # labels inside the text
        return False
    if not words <= asked:
        words = set(_WORD.findall("\n".join(_LABEL.sub("", x) for x in t.plain.split("\n")).lower()))
    return words <= asked and len(words) >= 0.6 * len(asked)


def is_other_language(t: Text, q: Text) -> bool:
    if not t.lang or not q.lang or t.lang == q.lang:
        return False
    return t.votes["zh"] < 2 if q.lang == "zh" else t.votes[q.lang] <= 0.25 * t.votes[t.lang]


_END = re.compile(r"[.!?。！？…:：;)\]}»”\"'’|>`*]$")
_LIST = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+\S")
_DANGLING = re.compile(
    r"(?:[,，、;；(\[{“«–—-]|\b(?:the|a|an|of|and|or|to|in|on|at|by|for|from|with|only|but|if|because|while|that|which|is|are|has|have|der|die|das|den|dem|ein|eine|und|oder|von|mit|für|bei|wenn|ob|weil|le|la|les|un|une|des|du|de|et|ou|dans|pour|car|si|el|los|las|una|del|y|o|en|por|con|para|que|porque))$",
    re.I,
)


def unfinished(t: str) -> bool:
    """No sentence end, closing mark or list end; short answers without a verb (a name, a number, a term) are whole."""
    if t.rfind("[") > t.rfind("]"):
        return True
    s = _CITE.sub(" ", _clean(t[-300:])).strip() if len(t) > 300 and "[" not in t[-300:-200] else _CITE.sub(" ", _clean(t)).strip()
    if not s:
        return False
    if _END.search(s):
        opened, closed = s.count("(") + s.count("["), s.count(")") + s.count("]")
        return opened > closed and s.rfind("(") > len(s) - 60
    if _DANGLING.search(s):
        return True
    line = s.rsplit("\n", 1)[-1]
    if _LIST.match(line) or _LIST.match(s):
        return _DANGLING.search(line) is not None
    if _HAN.search(line):
        return len(_HAN.findall(line)) > 8
    words = _WORD.findall(line)
    if len(words) <= 5 and any(w.isdigit() for w in words):
        return False
    return len(words) >= 4 and sum(w[0].islower() for w in words) >= 2 or len(words) > 8


def rule(raw: str | None, question: str | None, index: dict[str, frozenset[str]] = _INDEX) -> str | None:
    """The defect that the pair itself shows."""
    return _rule(None if raw is None else Text(raw, index), Text(question, index) if question else None)


def _rule(t: Text | None, q: Text | None) -> str | None:
    if is_empty(t):
        return "empty"
    if q and is_copy(t, q):
        return "copy"
    if is_refusal(t):
        return "refusal"
    if q and is_other_language(t, q):
        return "other_language"
    return "truncated" if unfinished(t.raw) else None


def language_words(texts: DataFrame, sure: float = 0.9, share: float = 0.001) -> dict[str, frozenset[str]]:
    """The function words, and what the collection adds: words of at least ``share`` of its texts of which ``sure`` stand in
    texts whose function words speak clearly for one language. texts: (text). At most one row per frequent word is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words = _WORD.findall(t.lower())
                v = _votes(words, _INDEX)
                second, first = sorted(v.values())[-2:]
                lang = max(v, key=v.get) if first >= 3 and first >= 2 * second else ""
                n.update((w, lang) for w in set(words) if not w.isdigit())
                n["", lang] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([k for _, k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "lang", "n"])

    said = texts.where("text is not null").select("text").mapInArrow(run, "word string, lang string, n bigint")
    known = F.sum(F.when(F.col("lang") != "", F.col("n")).otherwise(0))
    per = materialize(said.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words").groupBy("word").agg(F.sum("n").alias("all"), known.alias("known"), F.max_by("lang", F.when(F.col("lang") != "", F.col("n")).otherwise(0)).alias("lang"), F.max(F.when(F.col("lang") != "", F.col("n")).otherwise(0)).alias("most"))
    total = per.where("word = ''").first()
    if total is None:
        return _INDEX
    rows = per.where((F.col("word") != "") & (F.col("all") >= share * total["all"]) & (F.col("known") >= 0.5 * F.col("all")) & (F.col("most") >= sure * F.col("known"))).collect()
    return {**{r.word: frozenset([r.lang]) for r in rows if r.lang and r.most >= 5}, **_INDEX}


_LINES = re.compile(r"\s*\n\s*")


def comparable(plain: str) -> str:
    """A response without marks, citations and labels as it is sorted: in lower case, without repeated blanks."""
    t = plain.lower()
    t = "\n".join(" ".join(x.split()) for x in _LINES.split(t)) if "\n" in t else " ".join(t.split())
    for mark in ".,;:!?。！？":
        t = t.replace(" " + mark, mark)
    return t


_HASH = "xxhash64(text)"


def _judged(records: DataFrame, index) -> DataFrame:
    """(record_id, field, defect, open, n, text): the rule's verdict, whether the end is open, the length, and the text to be
    compared with others, null where the rule found another defect than truncated."""
    schema = "record_id bigint, field string, defect string, open boolean, n int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields, texts, questions = b.columns
            tx, qs = texts.to_pylist(), questions.to_pylist()
            answers = [None if t is None else Text(t, index.value) for t in tx]
            asked: dict[str, Text] = {}
            for q in qs:
                if q and q not in asked:
                    asked[q] = Text(q, index.value)
            found = [_rule(t, asked.get(q)) for t, q in zip(answers, qs)]
            is_open = [f == "truncated" or f is None and not _END.search(t.rstrip()) for f, t in zip(found, tx)]
            plain = [comparable(t.plain) if f in (None, "truncated") else None for f, t in zip(found, answers)]
            yield pa.RecordBatch.from_arrays(
                [ids, fields, pa.array(found, pa.string()), pa.array(is_open, pa.bool_()), pa.array([len(t or "") for t in tx], pa.int32()), pa.array(plain, pa.string())],
                names=["record_id", "field", "defect", "open", "n", "text"],
            )

    return records.select("record_id", "field", "text", "question").mapInArrow(run, schema).withColumn("h", F.expr(_HASH))


def _shortened_of(t: str, longer: str) -> bool:
    """t is a proper prefix of longer and ends inside a sentence of it."""
    if len(t) >= len(longer) or not longer.startswith(t) or t.strip().isdigit():
        return False
    rest = longer[len(t) :]
    if not rest.strip() or "\n" in rest[:1] or _CITE.match(rest.strip()) or not _CITE.sub("", rest).strip(" .。\n"):
        return False
    if re.search(r"[.!?。！？…\]]\s*$", t):
        return bool(re.match(r"\d", rest)) and bool(re.search(r"\d\.$", t))
    return True


def shortened(texts: DataFrame) -> DataFrame:
    """(h) of the texts that are shortened versions of another one. texts: (text). Repeated texts are merged before the sort;
    the sort is a range partitioning, each partition is read as a stream. What begins with a text follows it without a gap,
    so the stream keeps a stack of texts, each the beginning of the next, that no follower has yet shown to be shortened.
    Those left at the end of a partition meet the first text of the next one on the driver; where that goes on without
    showing it, one more pass over the texts looks for one that does."""
    schema = "kind string, part int, h bigint, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stack, first = TaskContext.get().partitionId(), [], None
        for b in batches:
            out = []
            for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = first or (t, h)
                while stack and not t.startswith(stack[-1][0]):
                    stack.pop()
                if stack:
                    hits = {x[1] for x in stack if _shortened_of(x[0], t)}
                    out += hits
                    stack = [x for x in stack if x[1] not in hits]
                stack.append((t, h))
            if out:
                yield pa.RecordBatch.from_pydict({"kind": ["hit"] * len(out), "part": pa.array([part] * len(out), pa.int32()), "h": out, "text": pa.nulls(len(out), pa.string())})
        if first is not None:
            left = [first, *stack]
            yield pa.RecordBatch.from_pydict({"kind": ["first"] + ["open"] * len(stack), "part": pa.array([part] * len(left), pa.int32()), "h": [h for _, h in left], "text": [t for t, _ in left]})

    distinct = texts.where("text is not null").groupBy("text").agg(F.expr(_HASH).alias("h"))
    out = materialize(distinct.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(run, schema), "neighbours")
    edge = out.where("kind <> 'hit'").collect()  # a row per partition, and its open texts, each the beginning of the next
    first = sorted((r.part, r.text) for r in edge if r.kind == "first")
    after = {p: t for (p, _), (_, t) in zip(first, first[1:])}
    near = [r for r in edge if r.kind == "open" and after.get(r.part, "").startswith(r.text)]
    hits = [r.h for r in near if _shortened_of(r.text, after[r.part])]
    found = out.where("kind = 'hit'").select("h").union(out.sparkSession.createDataFrame([(h,) for h in hits], "h bigint"))
    rest = [(r.text, r.h) for r in near if not _shortened_of(r.text, after[r.part])]
    if not rest:
        return found

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tx = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([h for x, h in rest if any(_shortened_of(x, t) for t in tx)], pa.int64())], names=["h"])

    return found.union(texts.where("text is not null").select("text").mapInArrow(look, "h bigint"))


def _rare(k: int, mean: float) -> float:
    """Probability of k or more where ``mean`` are expected (Chernoff's bound of a Poisson count)."""
    return 1.0 if k <= mean else math.exp(k - mean - k * math.log(k / mean))


def length_limits(judged: DataFrame, chance: float = 0.001) -> list[tuple[str, int]]:
    """(field, length) of the length limits: lengths that more open-ended texts have than chance lets expect from the ten
    lengths on either side, and than there are texts beyond. One row per field and length comes to the driver."""
    c = judged.groupBy("field", "n").agg(F.count("*").alias("all"), F.count_if("open").alias("open")).collect()
    out = []
    for field in {r.field for r in c}:
        open_, beyond = {r.n: r.open for r in c if r.field == field}, 0
        for r in sorted((r for r in c if r.field == field), key=lambda r: -r.n):
            mean = (1 + sum(open_.get(r.n + d, 0) for d in range(-10, 11) if d)) / 20
            if r.open > beyond and _rare(r.open, mean) < chance / len(open_):
                out.append((field, r.n))
            beyond += r["all"]
    return sorted(out)


def _evidence(records: DataFrame) -> DataFrame:
    """(record_id, field, defect, neighbour, limit): verdict of the rules, and whether a longer version or a limit tells that
    the text is cut."""
    index = records.sparkSession.sparkContext.broadcast(language_words(records.select("text")))
    judged = materialize(_judged(records, index), "judged")
    limits = [F.col("open") & (F.col("field") == f) & (F.col("n") == n) for f, n in length_limits(judged)]
    cut = shortened(judged.select("text")).distinct()
    at_limit = F.lit(False)
    for x in limits:
        at_limit = at_limit | x
    return judged.join(cut.withColumn("cut", F.lit(True)), "h", "left").select("record_id", "field", "defect", F.coalesce("cut", F.lit(False)).alias("neighbour"), F.coalesce(at_limit, F.lit(False)).alias("limit"))


def defects(records: DataFrame) -> DataFrame:
    """(record_id, field, defect). records: (record_id, field, text, question)."""
    cut = F.when(F.col("neighbour") | F.col("limit"), "truncated")
    return _evidence(records).select("record_id", "field", F.coalesce("defect", cut).alias("defect")).where("defect is not null").distinct()


def evidence(records: DataFrame) -> DataFrame:
    """(defect, by_rule, by_neighbour, by_limit, texts): how many texts each combination of evidence tells to be defective."""
    e = _evidence(records).distinct().where("defect is not null or neighbour or limit")
    return e.groupBy(F.coalesce("defect", F.lit("truncated")).alias("defect"), F.col("defect").isNotNull().alias("by_rule"), F.col("neighbour").alias("by_neighbour"), F.col("limit").alias("by_limit")).agg(F.count("*").alias("texts"))


def prompt_question(prompt: str = "prompt"):
    """The question at the end of a prompt: what follows the last question label, else the last line."""
    return F.coalesce(
        F.nullif(F.regexp_extract(prompt, r"(?s).*(?:^|\n)\s*(?:#+\s*)?(?:Question|Frage|Pregunta|问题)\s*:?\s*(.+?)\s*$", 1), F.lit("")),
        F.regexp_extract(prompt, r"([^\n]*\S)\s*$", 1),
    )


def pair_records(rephrased: DataFrame, preferences: DataFrame) -> DataFrame:
    """(record_id, field, text, question, intended) of both tables; intended: a refusal is what is wanted there."""
    a = rephrased.select(F.col("variant_id").alias("record_id"), F.lit("answer").alias("field"), F.col("answer").alias("text"), F.col("result").alias("question"), F.lit(False).alias("intended"))
    q = prompt_question()
    reject = F.coalesce(F.col("data_gen_type").contains("positive_are_reject"), F.lit(False))
    b = preferences.select(
        F.col("pair_id").alias("record_id"),
        q.alias("question"),
        F.explode(F.array(F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("text"), reject.alias("intended")), F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("text"), F.lit(False).alias("intended")))).alias("x"),
    ).select("record_id", "x.field", "x.text", "question", "x.intended")
    return a.unionByName(b)


def defective_pairs(rephrased: DataFrame, preferences: DataFrame) -> DataFrame:
    """(record_id, field, defect) over both tables; an intended refusal is no defect."""
    found = defects(pair_records(rephrased, preferences))
    wanted = preferences.where(F.col("data_gen_type").contains("positive_are_reject")).select(F.col("pair_id").alias("record_id"), F.lit("chosen").alias("field"), F.lit("refusal").alias("defect")).distinct()
    return found.join(wanted, ["record_id", "field", "defect"], "left_anti").select("record_id", "field", "defect")
