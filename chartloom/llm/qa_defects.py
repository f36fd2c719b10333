"""Unusable answers: ordered rules over each question and answer, every triggered type emitted.

The rules are JVM expressions and look at their row alone. An answer cut within a word is
told by a fixed lexicon, the words of a public tokenizer: a last word that is none of them
but the beginning of one is a fragment, and a clause without a full stop has to end in a
whole word.

Types in order of priority: empty, copied_question, refusal, truncated, other_language.

Defined results for odd input: a null or blank answer is empty whatever the question; with a
null question the rules that compare with it do not trigger; very long answers are read
whole; repeated rows each keep their verdict; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.columns import shielded
from chartloom.functions.text import ENTITIES
from chartloom.llm.bpe import TOKENIZER_DIR
from chartloom.llm.questions import INTERROGATIVES, OPENINGS, content_tokens, plain_text

LEXICON_FILE = "word_bpe_49k.json"  # tokens of this vocabulary that end a word are the lexicon
WHOLE_LENGTH = 6  # letters from which on a word of the lexicon is taken for whole
FEW_LONGER = 2  # words of the lexicon that may begin with a shorter word taken for whole
COMMON = 6000  # rank of other words of four and five letters that are taken for whole
LONGEST = 40  # letters of a last word that is looked up
MARKS = " \t\r\n\"'().:!*_-"  # around a placeholder
ORDER = ["empty", "copied_question", "refusal", "truncated", "other_language"]

# What stands in place of an answer.
PLACEHOLDERS = r"(?:n/?a|n\.a\.?|none|null|nil|nan|undefined|tbd|t\.b\.d\.|todo|to do|pending|placeholder|answer|no answer|not available|not applicable|missing|empty|blank|unknown|xxx+|lorem ipsum.*|insert answer.*|your answer.*|answer here|see above|<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\})"
# Refusals for reasons of policy, privacy or ability, by language.
REFUSALS = "|".join(
    [
        r"\bas an? (?:ai|language model|assistant|automated)", r"\bbeing an (?:ai|automated|assistant)", r"language model",
        r"\bi(?:'m| am)? ?(?:sorry|apologi[sz]e)[^.]{0,20}\b(?:can'?t|cannot|not|unable|won'?t|must|have to)\b",
        r"\bi (?:can'?t|cannot|can not|could not|won'?t|will not|must not|may not|shouldn'?t) (?:help|assist|provide|answer|discuss|comment|give|share|disclose|go into|interpret|advise|speculate|reveal|talk|respond|offer)",
        r"\b(?:unable|not able|not permitted|not allowed|not in a position|not authori[sz]ed) to (?:help|assist|provide|answer|discuss|comment|give|share|disclose|interpret|advise|speculate|respond|go)",
        r"(?:must|have to|need to|will|would) (?:respectfully )?decline", r"\brather not (?:speculate|say|answer|comment|discuss)", r"leave this question unanswered",
        r"not something i can (?:comment|discuss|answer|help|share)", r"no comment can be given", r"guidelines (?:do not|don't) (?:allow|permit)", r"(?:against|violates?|violate) (?:my |the |patient )?(?:policy|policies|guidelines|privacy|rules)",
        r"beyond what i am (?:able|allowed)", r"for (?:privacy|safety|legal|policy) reasons,? (?:i|we|this)",
        r"\bich (?:kann|darf|möchte|werde) (?:[\p{L} ,]{0,60})?(?:nicht|keine)\b[^.]{0,60}(?:beantworten|helfen|geben|äußern|sagen|auskunft)", r"tut mir leid", r"als (?:ki|sprachmodell)\b", r"(?:aus|wegen) (?:gründen des |des )?datenschutz",
        r"\bje (?:ne peux|ne suis|regrette|suis désolé)", r"en tant qu(?:'|e )(?:ia|assistant|modèle)", r"désolé,? (?:mais )?je",
        r"\blo siento\b", r"\bno (?:puedo|estoy autorizad[oa]) (?:[\p{L}]+ )?(?:responder|ayudar|dar|proporcionar|comentar|hablar|facilitar|a )", r"como (?:modelo de lenguaje|ia|inteligencia|asistente)",
        r"\bnon posso (?:rispondere|aiutare|fornire|commentare|dare)", r"mi dispiace", r"não posso (?:responder|ajudar|fornecer|comentar|dar)", r"lamento,? mas", r"ik kan (?:daar|dit|hier|u|geen)[^.]{0,40}(?:niet|geen)",
    ]
)
# Words after which a sentence goes on, and clause openings that need a full stop in the end.
OPEN_ENDS = """the a an of to and or but with in on at by for from as that which who because since while when where until before after into than then so if is was were are be been being had has have
not due order spite compared together well first second third raised given shortly about between during under over via per their its his her this these those moved drawn
der die das den dem des ein eine einen und oder aber weil wurde wird war ist mit von zu bei für im am auf nach
le la les un une des du de et ou mais parce que qui dans pour avec sur était est a été
el los las una unos y o pero porque que con por para en fue es del al se""".split()
CLAUSES = r"\b(?:because(?! of\b)|whereas|although|which|despite|following|after which|with subsequent|so that|in order to|as documented|where it|(?:shows|notes|states|says|found|noted) that|while the|before being|and was then|but it|after the [a-z]+ (?:had|could|was)|and the|(?:weil|parce que|porque) )\b|\band was\b"
# A clause that has named its subject and nothing more.
FINITE = "is|was|are|were|had|has|have|did|does|took|rose|fell|went|came|got|can|could|will|would|needs?|stayed|received|occurred|improved|changed|remained|increased|decreased|started|stopped"
BARE_SUBJECT = rf"\b(?:shows|notes|states|says|found|noted) that (?!(?:[^ ]+ )*(?:{FINITE})\b)(?:the )?[\p{{L}},]+(?: [\p{{L}},]+){{0,7}}$"
# A last word on its own after a comma, where it is no whole word.
LONE_TAIL = r", (?:with |as )?[\p{L}]+$"
# Units that end an answer without a full stop.
UNITS = "bpm mmhg mg mcg g kg ml l unit units meq mmol kpa degrees percent points breaths minute minutes hour hours day days week weeks times".split()
# Frequent words that tell languages apart.
LANGUAGES = {
    "en": "the of and was is it on in to for after before with that were had be by from at not this there an which who what how did been about given value note patient during only later",
    "de": "der die das und war wurde den dem des ein eine ist im am bei von zu nicht mit auf für nach wie hoch wert danach er sie langsam steht dass weil zuerst kam folgte etwa kurz den unterlagen gemessen aufnahme station dann",
    "fr": "le la les des et était est une un du au dans pour par que qui elle il selon puis lentement dossier valeur quelle mesuré après été avec pas ce cette jour parce environ peu sur indiqué lettre sortie traitement commencé autre premier",
    "es": "el los las fue era y del un una se que según después con por para cuál valor registro subió lentamente al día paciente porque unos poco consta informe alta primero luego tratamiento inició otra sala medido ingreso planta",
    "it": "il lo gli era di che è stato stata con per non una un della del nel secondo cartella poi salito lentamente valore ed mattina dopo prima dato perché febbre terapia iniziata quel giorno circa ricontrollato",
    "pt": "o os as era foi de do da um uma que não com para por segundo registo depois devagar subiu valor verificado manhã seguinte tratamento começou nesse dia porque cerca na no pouco",
    "nl": "de het een en was werd van in op met dat niet voor bij volgens dossier daarna liep langzaam waarde volgende ochtend opnieuw gemeten die dag begonnen omdat koorts zakte ongeveer kort na",
}


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)([\p{L}]+)"), F.lit(1))


def _telling(words: Column) -> Column:
    """The distinct words that tell languages apart; most words don't."""
    every = sorted({w for text in LANGUAGES.values() for w in text.split()})
    return F.array_distinct(F.filter(words, lambda w: w.isin(*every)))


def _language_scores(words: Column) -> dict[str, Column]:
    def count(text: str) -> Column:
        own = sorted(set(text.split()))
        return F.size(F.filter(words, lambda w: w.isin(*own)))

    return {lang: count(text) for lang, text in LANGUAGES.items()}


def _share(c: Column, script: str) -> Column:
    return F.length(F.regexp_replace(c, rf"[^{script}]", "")) / F.greatest(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit(1))


def lexicon(spark: SparkSession, directory: str = TOKENIZER_DIR, file: str = LEXICON_FILE) -> DataFrame:
    """(_end, _known, _whole): words and beginnings of words of a tokenizer that marks word ends.

    ``_known`` says whether it is a word at all, ``_whole`` whether it is likely to stand for
    itself rather than for the beginning of a longer one. The size is that of the vocabulary.
    """
    with open(os.path.join(directory, file), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted({t[:-4] for t in vocab if t.endswith("</w>") and t[:-4].isalpha() and 2 <= len(t) - 4 <= LONGEST})
    known, rows = set(words), []
    for w in words:
        longer = bisect_left(words, w + "\uffff") - bisect_left(words, w) - 1
        common = len(w) >= 4 and vocab[w + "</w>"] < COMMON and vocab.get(w, 1 << 30) > vocab[w + "</w>"]
        rows.append((w, True, len(w) >= WHOLE_LENGTH or (len(w) >= 4 and longer <= FEW_LONGER) or common))
    rows += [(w, True, True) for w in sorted(set(ENTITIES) - known)]
    known |= set(ENTITIES)
    begins = {w[:k] for w in words for k in range(2, len(w))} - known
    columns = zip(*rows, *((w, False, False) for w in sorted(begins)))
    return spark.createDataFrame(pa.Table.from_pydict(dict(zip(("_end", "_known", "_whole"), map(list, columns)))))


def defect_rules(pairs: DataFrame, directory: str = TOKENIZER_DIR, file: str = LEXICON_FILE) -> DataFrame:
    """``pairs`` rows with ``defects``, every triggered type in order of priority."""
    pairs, kept = shielded(pairs, lambda c: c.startswith("_"), ["defects"])
    rows = pairs.withColumn("_a", plain_text(F.coalesce("answer", F.lit("")))).withColumn("_q", plain_text(F.coalesce("question", F.lit(""))))
    bare = F.regexp_replace("_a", r"(?U)[^\p{L}\p{N}]+", "")
    empty = (bare == "") | F.btrim("_a", F.lit(MARKS)).rlike(rf"^{PLACEHOLDERS}$") | F.col("_a").rlike(rf"^{PLACEHOLDERS}[.:]?$")

    rows = rows.withColumn("_qt", content_tokens(F.col("_q"))).withColumn("_at", content_tokens(F.col("_a"))).withColumn("_aw", _words(F.col("_a"))).withColumn("_qw", _words(F.col("_q")))
    shared = F.size(F.array_intersect("_qt", "_at"))
    asks = F.col("_a").rlike(r"\?[\s\"')]*$") | (F.size(F.array_intersect("_aw", F.array(*[F.lit(w) for w in INTERROGATIVES]))) > 0) | F.col("_a").rlike(rf"^{OPENINGS}\b")
    same = (F.regexp_replace("_a", r"(?U)[^\p{L}\p{N}]+", "") == F.regexp_replace("_q", r"(?U)[^\p{L}\p{N}]+", "")) & (bare != "")
    copied = same | (asks & (F.size("_qt") > 0) & (shared >= 0.75 * F.size("_qt")) & (F.size(F.array_except("_at", "_qt")) <= 0.2 * F.size("_qt")))

    refusal = F.col("_a").rlike(f"(?U)(?:{REFUSALS})")

    end = F.col("_a")  # blanks are single and none stands at the end, so every test here is linear in the text
    stopped = end.rlike(r"[.!?…。！？][\"'”’)\]»]*$") | end.rlike(r"[)\]]$")
    last = F.lower(F.regexp_extract(end, r"(?U)([\p{L}]+)$", 1))
    opened = F.length(F.regexp_replace(end, r"[^(\[]", "")) > F.length(F.regexp_replace(end, r"[^)\]]", ""))
    dangling = end.rlike(r"[,;:(–—-]$")
    number_end = F.col("_a").rlike(r"\b(?:received|between|(?:increased|rose|fell|decreased|dropped|went|changed) from|from|until) \d+[.,]?$") & ~F.col("_a").rlike(r"\bfrom [\d.,]+ .*\bto [\d.,]+[.,]?$")
    rows = rows.withColumn("_open", ~stopped & (F.size("_aw") > 1)).withColumn("_last", last).withColumn("_end", F.when(F.col("_open") & F.col("_a").rlike(r"(?U)(?:^|\s)\p{L}+$") & ~last.isin(*UNITS), last))
    rows = rows.join(F.broadcast(lexicon(pairs.sparkSession, directory, file)), "_end", "left")
    before = F.concat("_qw", F.expr("slice(_aw, 1, greatest(size(_aw) - 1, 0))"))
    fragment = F.coalesce(~F.col("_known"), F.lit(False)) & ~F.array_contains(before, F.col("_last"))
    clause = (F.col("_a").rlike(CLAUSES) | F.col("_a").rlike(f"(?U){LONE_TAIL}")) & (F.size("_aw") >= 3) & F.col("_end").isNotNull() & ~F.coalesce(F.col("_whole"), F.lit(False))
    clause = clause | F.col("_a").rlike(f"(?U){BARE_SUBJECT}")
    truncated = (F.col("_open") & (F.col("_last").isin(*sorted(set(OPEN_ENDS))) | clause | fragment)) | (~stopped & dangling & (F.size("_aw") > 0)) | opened | (number_end & (F.size("_aw") > 2))

    rows = rows.withColumns({"_qk": _telling(F.col("_qw")), "_ak": _telling(F.col("_aw"))})
    q_scores, a_scores = _language_scores(F.col("_qk")), _language_scores(F.col("_ak"))
    langs = list(LANGUAGES)
    best = lambda scores: F.array_max(F.array(*[F.struct(scores[x].alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]))
    rows = rows.withColumn("_ql", best(q_scores)).withColumn("_al", best(a_scores))
    own = F.create_map(*[x for lang in langs for x in (F.lit(lang), a_scores[lang])])
    foreign = (F.col("_ql.n") > 0) & (F.col("_al.n") >= 2) & (F.col("_al.lang") != F.col("_ql.lang")) & (F.col("_al.n") >= 2 + F.try_element_at(own, F.col("_ql.lang")))
    foreign = foreign | ((F.col("_ql.n") > 0) & (F.col("_al.n") >= 2) & (F.try_element_at(own, F.col("_ql.lang")) == 0))
    other_script = F.lit(False)
    for script in (r"\p{IsCyrillic}", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}", r"\p{IsArabic}", r"\p{IsGreek}", r"\p{IsHangul}", r"\p{IsHebrew}", r"\p{IsDevanagari}"):
        other_script = other_script | ((_share(F.col("_a"), script) > 0.5) & (_share(F.col("_q"), script) < 0.1))
    # Shares of scripts are only counted where a letter isn't Latin.
    language = (foreign | (F.col("_a").rlike(r"[\p{L}&&[^\p{IsLatin}]]") & other_script)) & (F.col("_q") != "")

    rules = {"empty": empty, "copied_question": copied & ~empty, "refusal": refusal & ~empty, "truncated": truncated & ~empty, "other_language": language & ~empty}
    defects = F.filter(F.array(*[F.when(F.coalesce(rules[k], F.lit(False)), F.lit(k)) for k in ORDER]), lambda x: x.isNotNull())
    return rows.withColumn("defects", defects).select(*kept, "defects")


def unusable_answers(pairs: DataFrame) -> DataFrame:
    """(qa_id, defect): the first type of every defective pair."""
    return defect_rules(pairs.select(F.col("qa_id").cast("bigint").alias("qa_id"), "question", "answer")).where("size(defects) > 0").select("qa_id", F.get("defects", F.lit(0)).alias("defect")).distinct()
