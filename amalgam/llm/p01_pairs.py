"""Broken prompt and response pairs.

A response is cut to clauses (sentences, list lines, the text of a JSON value),
and a conditional random field tags each as answer, refusal, echo, foreign or
unfinished from its own features (words and word pairs, share of its word triples
standing in the prompt, language against the language asked for, how it ends,
place in the response) and its neighbours' tags. The share of the response that
each tag covers decides the defect of the pair.

The field is trained here, on a bounded sample of pairs (``TRAIN_PAIRS`` different
ones, the first in hash order). No label is computed from the features:

* unfinished, echo and foreign clauses are planted: a response of the sample is
  cut somewhere, replaced by its prompt or the line that asks (in other letters,
  without marks, quoted), or exchanged with one in another language;
* refusals are labelled by two weak labellers that no feature holds: a list of
  phrases, and recurrence (a response that brings nothing of its prompt and stands
  word for word, names aside, under several different prompts). The field sees
  only words and word pairs;
* the clauses of the sample are answers where they bring a number, or words of the
  prompt that are no names; all others are left open between answer and refusal,
  those that may be echo, foreign or unfinished between answer and that, and the
  field is fitted to the allowed labels only.

Word lists of languages are counted over all pairs.
"""

from __future__ import annotations

import json
import pickle
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from amalgam.llm.crf import ChainCRF
from amalgam.llm.normal import fold
from amalgam.runtime import cut, drop, load, scratched

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: Different pairs of the training sample and their greatest length in characters (longer ones
#: are judged, not learnt from), hashed features, and words a language list keeps.
TRAIN_PAIRS, TRAIN_CHARS, N_FEATURES, LANGUAGE_WORDS, SEED = 4000, 20_000, 1 << 14, 3000, 61
#: Odds of a refusal against an answer where a clause of the sample is left open.
REFUSAL_ODDS = 0.3
#: Different prompts under which a wording that brings nothing of them counts as a refusal.
CANNED = 3
USER_ROLES, ANSWER_ROLES = ("user", "human", "customer", "prompter"), ("assistant", "model", "bot", "ai", "gpt")
# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to is was for with on that it from at by not only are an this which who what why can does did near until every will they when if between of their there yes before more stay stays",
    "de": "der die das und ist in zu den dem ein eine nicht mit von für auf im wird sie es wurde bei nach nur aber oder über am warum kann was wer ich zwei schreibe fasse ja nein vor wenn jeden doch dann ob als",
    "fr": "le la les des et est dans une un que qui pour par sur pas avec du au aux chez elle il en ou où près mais oui non avant ce cette seulement écris résume pourquoi puis je quand mois deux après jusqu'à",
    "es": "el la los las de y es en un una que por para con del al se no su pero sí cuando cerca hasta antes solo solamente qué quién puedo escribe resume desde entre muy como llevó dicen",
    "it": "il lo la gli le di e è in un una che per con del della al alla si non ma sì quando vicino fino prima solo soltanto chi cosa perché posso scrivi riassumi da dal dei nel due su come anche",
}
_YES_NO = {"no": {"en", "es", "it"}, "yes": {"en"}, "nein": {"de"}, "ja": {"de"}, "non": {"fr"}, "oui": {"fr"}, "sí": {"es"}, "si": {"es", "it"}, "sì": {"it"}}
# Phrases by which refusals of the training sample are labelled.
REFUSALS = [
    "i'm sorry", "i am sorry", "i'm afraid", "can't help", "cannot help", "cannot assist", "can't assist", "unable to help", "unable to answer", "unable to provide", "unable to assist",
    "not able to help", "not able to answer", "won't be able to", "can't answer", "cannot answer", "cannot discuss", "cannot provide", "as a language model", "as an ai", "must decline", "decline to",
    "refuse to", "not comfortable", "am comfortable writing", "not allowed to", "against my guidelines", "against my policy", "against my rules", "contact support directly",
    "tut mir leid", "nicht helfen", "keine auskunft", "ich leider ablehnen", "als sprachmodell", "nicht beantworten",
    "suis desole", "ne peux pas repondre", "ne peux pas vous aider", "en tant qu'assistant", "m'est impossible de", "prefere ne pas", "dois refuser",
    "lo siento", "no puedo ayudar", "no puedo responder", "como modelo de lenguaje", "no me es posible", "debo rechazar",
    "mi dispiace", "non posso aiutar", "non posso rispondere", "in quanto assistente", "non sono in grado di", "devo declinare", "devo rifiutare",
    "申し訳", "お答えできません", "できません", "お手伝いできません",
]
_ASKS = re.compile(
    r"^\W*(?:write|summari[sz]e|who|why|what|when|where|how|can|could|does|do|is|translate|fill|extract|reply|evidence below|list|describe|give|tell|explain|answer|"
    r"schreibe?|fasse|wer|warum|was|wann|wo|wie|kann|konnen|ubersetze?|nenne|beschreibe|"
    r"ecris|ecrivez|resume[rz]?|qui|pourquoi|que|quand|ou|comment|puis|peut|tradui\w+|decris|"
    r"escribe|quien|por que|como|cuando|puedo|traduc\w+|describe|"
    r"scrivi|riassumi|chi|perche|che cosa|cosa|quando|posso|tradu\w+|descrivi)\b"
)
_INTO = re.compile(r"\b(?:translate|ubersetze?|tradui\w*|traduc\w*|traduci)\b.{0,30}?\b(?:into|to|ins?|auf|en|al?|in)\s+(?:das |la |le |el |l')?(english|englisch\w*|anglais|ingles\w*|german|deutsch\w*|allemand|aleman|tedesco|french|franzosisch\w*|francais|frances\w*|spanish|spanisch\w*|espagnol|espanol|spagnolo|italian\w*|italien\w*|japan\w*|giapponese)")
_TARGETS = {"engl": "en", "angl": "en", "ingl": "en", "germ": "de", "deut": "de", "alle": "de", "alem": "de", "tede": "de", "fren": "fr", "fran": "fr", "span": "es", "espa": "es", "spag": "es", "ital": "it", "japa": "ja", "giap": "ja"}
_NOTHING = {"", "null", "none", "na", "nil", "undefined", "nan", "assistant", "model", "answer", "antwort", "response", "json", "tbd", "todo"}
_DIGIT = re.compile(r"\d")
_QUOTED = re.compile(r"\"[^\"]*\"|„[^“”]*[“”]|«[^»]*»|“[^”]*”")
_ENDS = re.compile(r"[.!?。！？»\"”’)\]}…]['\"”»)]*$")


def is_json(text: str) -> bool:
    return bool(re.match(r"^\s*(?:```\w*\s*)?[{\[]", text))


def says_nothing(text: str | None) -> bool:
    if text is None:
        return True
    bare = re.sub(r"<[^<>]*>|```\w*|[​-‍﻿]", " ", text)
    return re.sub(r"[\W_]+", "", bare).lower() in _NOTHING


def word_list(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text.lower().replace("’", "'"))


def instruction(prompt: str) -> str:
    """The line of a prompt that asks: the last that opens like a request, else
    the last that ends as a question, else the last."""
    lines = [x.strip() for x in prompt.strip().split("\n") if x.strip()] or [""]
    if len(lines) == 1:
        return lines[0]
    asking = [x for x in lines if x[0] == "¿" or _ASKS.match(fold(x))]
    if asking:
        # A context sentence can open like a request too; real ones ask or stand alone at an end.
        ends = [x for x in (lines[-1], lines[0]) if x in asking]
        return ends[0] if ends else asking[-1]
    questions = [x for x in lines if x.endswith(("?", "？"))]
    return questions[-1] if questions else lines[-1]


class Languages:
    """Languages by word lists: fixed function words and words learnt beside them."""

    def __init__(self, learnt: dict[str, dict[str, float]] | None = None):
        self.names = list(FUNCTION_WORDS)
        self.known: dict[str, list[float]] = {}
        lists = {k: {w: 2.0 for w in v.split()} for k, v in FUNCTION_WORDS.items()}
        for lang, words in (learnt or {}).items():
            for w, weight in words.items():
                lists[lang].setdefault(w, weight)
        for at, lang in enumerate(self.names):
            for w, weight in lists[lang].items():
                self.known.setdefault(w, [0.0] * len(self.names))[at] = weight

    def scores(self, text: str) -> dict[str, float]:
        if not text.isascii() and re.search(r"[぀-ヿ一-鿿]", text):
            return {"ja": 10.0}
        found = [k for w in word_list(text) if (k := self.known.get(w))]
        return dict(zip(self.names, map(sum, zip(*found)))) if found else dict.fromkeys(self.names, 0.0)

    def best(self, text: str, least: float = 2.0) -> str | None:
        ranked = sorted(self.scores(text).items(), key=lambda x: -x[1])
        if ranked[0][1] < least or (len(ranked) > 1 and ranked[0][1] < 1.15 * ranked[1][1] + 0.5):
            return None
        return ranked[0][0]

    def foreign(self, text: str, wanted: str | None) -> float:
        """How surely the text is in another language: -1 (as wanted) to 1."""
        if not wanted:
            return 0.0
        words = word_list(text)
        if len(words) == 1 and words[0] in _YES_NO:
            return -1.0 if wanted in _YES_NO[words[0]] else 1.0
        outside = _QUOTED.sub(" ", text)
        s = self.scores(outside if len(word_list(outside)) >= 3 else text)
        own, other = s.pop(wanted, 0.0), max(s.values(), default=0.0)
        if own + other == 0:
            return 0.0
        return max(-1.0, min(1.0, (other - own) / (own + other) * 1.5))


def words_beside(seed: Languages, texts: list[str]) -> Counter:
    """Counts of (language, word) of words in lines that function words tell the language of."""
    counts = Counter()
    for text in texts:
        for line in re.split(r"(?<=[.!?])\s+|\n", text):
            lang = seed.best(line, 4.0)
            if lang in FUNCTION_WORDS:
                low = {w for w in re.findall(r"(?<![^\W\d_'])[^\W\d_]+", line) if w[:1].islower() or lang == "de"}
                counts.update((lang, w) for w in {x.lower() for x in low})
    return counts


def learn_languages(pairs: DataFrame) -> Languages:
    """Adds to each language the words that stand beside its function words only,
    counted over the texts of all pairs; at most LANGUAGE_WORDS a language are kept."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed = Languages()
        for pdf in batches:
            found = words_beside(seed, [t for c in ("prompt", "response") for t in pdf[c] if t is not None])
            yield pd.DataFrame([(k, w, n) for (k, w), n in found.items()], columns=["lang", "word", "n"])

    counts = pairs.select("prompt", "response").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = counts.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "lang")).alias("m"))
    good = cut(words.filter((F.col("m.n") >= 3) & (F.col("m.n") / F.col("total") >= 0.9) & (F.length("word") > 2)).select("m.lang", "word", "m.n"))
    learnt = {}
    for lang in FUNCTION_WORDS:
        top = good.filter(F.col("lang") == lang).orderBy(F.desc("n"), F.desc("word")).limit(LANGUAGE_WORDS)
        learnt[lang] = {r["word"]: 1.5 for r in top.collect()}  # bounded by LANGUAGE_WORDS
    drop(good)
    return Languages(learnt)


def clauses(text: str) -> list[str]:
    """Clauses of a response; of a JSON error its text, of other JSON one clause."""
    if is_json(text):
        body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
        try:
            value = json.loads(body)
        except ValueError:
            return [text.strip()]
        inner = [v for v in value.values() if isinstance(v, str)] if isinstance(value, dict) else []
        if isinstance(value, dict) and set(value) & {"error", "message", "refusal"} and len(value) <= 2 and inner:
            text = " ".join(inner)
        else:
            return [text.strip()]
    out = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:\d+[.)]|[-*•])\s+", "", line)
        out += [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+(?=\S)", line) if p.strip()]
    return out or [text.strip()]


def _json_cut(text: str) -> bool:
    body = text.strip()
    fenced = body.startswith("```")
    if fenced and not body.endswith("```"):
        return True
    body = re.sub(r"^```\w*\s*|\s*```$", "", body)
    try:
        json.loads(body)
        return False
    except ValueError:
        quotes = len(re.findall(r'(?<!\\)"', body)) % 2
        return bool(quotes) or body.count("{") > body.count("}") or body.count("[") > body.count("]")


def ending(part: str) -> str:
    """How a clause ends: dots, an end mark, another mark, a number or a word."""
    if re.search(r"\w\s?(?:\.\.\.|…)$", part):
        return "dots"
    if _ENDS.search(part):
        return "end"
    if re.search(r"[,;:–—-]$", part):
        return "mark"
    return "number" if re.fullmatch(r"[\d\s.,+()-]+", part) else "word"


class Reader:
    """Features of the clauses of a response to a prompt."""

    def __init__(self, languages: Languages):
        self.languages = languages

    def wanted(self, prompt: str, asked: str | None = None, folded: tuple[str, str] | None = None) -> str | None:
        asked = instruction(prompt) if asked is None else asked
        line, whole = folded or (fold(asked), fold(prompt))
        m = _INTO.search(line) or _INTO.search(whole)
        if m:
            return _TARGETS.get(m[1][:4])
        return self.languages.best(asked, 1.5) or self.languages.best(prompt)

    def read(self, prompt: str, response: str) -> tuple[list[str], list[list[tuple[int, float]]]]:
        """Clauses, and the ids of the features of each."""
        parts, line = clauses(response), instruction(prompt)
        folded = fold(line), fold(prompt)
        wanted = self.wanted(prompt, line, folded)
        asked, given = (re.findall(r"\w+", x) for x in folded)
        grams = {tuple(given[i : i + 3]) for i in range(len(given) - 2)}
        in_line = {tuple(asked[i : i + 3]) for i in range(len(asked) - 2)}
        json_answer = is_json(response)
        whole = not json_answer or not _json_cut(response)
        ends = [ending(p) for p in parts]
        before = "none" if len(parts) == 1 else "ended" if any(e == "end" for e in ends[:-1]) else "open"
        out = []
        for i, part in enumerate(parts):
            plain = fold(part)
            said = re.findall(r"\w+", plain)
            structured = json_answer and part.lstrip("`json \n")[:1] in "{["
            names, telling = ["bias", f"first{i == 0}{json_answer}", f"long{min(4, len(said) // 4)}"], []
            if i == len(parts) - 1:
                if structured:
                    names.append(f"json{whole}")
                else:
                    size = min(5, len(said))
                    title = bool(re.match(r"^[^:]{2,60}: \S+(?: \S+){0,2}$", part))
                    names += [f"ends {ends[i]}", f"ends {ends[i]} {before}", f"ends {ends[i]} {size} {title} {before}"]
            if not structured:
                own = {tuple(said[k : k + 3]) for k in range(len(said) - 2)}
                share = len(own & grams) / len(own) if own else -1.0
                held = len(own & in_line) / len(in_line) if in_line else -1.0
                names += [f"given {share >= 0}{share >= 0.4}{share >= 0.8}", f"asks {held >= 0}{held >= 0.4}{held >= 0.8}"]
                far = self.languages.foreign(part, wanted)
                names.append(f"tongue {far > -0.3}{far > 0}{far >= 0.15}{far >= 0.5}")
                if not _DIGIT.search(plain):
                    telling = [f"w {w}" for w in set(said)] + [f"w {a} {b}" for a, b in set(zip(said, said[1:]))]
                else:
                    names.append("digits")
            weight = min(1.0, 8.0 / max(1, len(said)))  # the words of long clauses count no more than those of short ones
            out.append([(zlib.crc32(x.encode()) % N_FEATURES, 1.0) for x in names] + [(zlib.crc32(x.encode()) % N_FEATURES, weight) for x in telling])
        return parts, out


def skeleton(text: str) -> str:
    """The wording of a response: its words without names (capitals) and numbers."""
    return " ".join(re.sub(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ]\w*|\d+", " ", text).split())


def planted(sample: list[tuple[str, str]], reader: Reader, random_: random.Random, refusals: list[str]) -> list[tuple[str, str, str]]:
    """(prompt, response, label) with the label of the clauses planted: at least
    one a pair of the sample and 300 in all."""
    told = [(p, r) for p, r in sample if not says_nothing(r)]
    by: dict[str | None, list[str]] = {}
    for _, r in told:
        if not is_json(r):
            by.setdefault(reader.languages.best(r, 4.0), []).append(r)
    asked_in: dict[str | None, list[str]] = {}
    for p, _ in told:
        asked_in.setdefault(reader.wanted(p), []).append(p)
    out: list[tuple[str, str, str]] = []
    for at in range(max(len(told), 300) if told else 0):
        prompt, response = told[at % len(told)]
        kind = at % 3
        if kind == 0:
            if len(response) < 30:
                continue
            cut_at = random_.randint(len(response) * 3 // 10, len(response) * 95 // 100)
            piece = response[:cut_at].rstrip()
            if is_json(response):
                if not _json_cut(piece):
                    continue
            else:
                if ending(piece) != "word" and not piece.endswith(","):
                    continue
                piece += random_.choice(["", "", "", "...", "…", ",", " –", " -"])
            out.append((prompt, piece, "unfinished"))
        elif kind == 1:
            line = instruction(prompt)
            text = random_.choice([prompt, prompt, line, line, line.split(": ", 1)[-1]])
            if len(text.split()) < 4:
                continue
            lead = " ".join(re.findall(r"[^\W\d_]+", told[random_.randrange(len(told))][1])[:2])
            change = random_.choice([str, str, str.upper, str.lower, lambda t: re.sub(r"[,.;:?!¿]", "", t), lambda t: f'"{t}"', lambda t: f"{t}.", lambda t: f"{lead}: {t}"])
            out.append((prompt, change(text), "echo"))
        else:
            wanted = reader.wanted(prompt)
            others = [k for k in by if k is not None and k != wanted]
            if wanted and others:
                out.append((prompt, random_.choice(by[random_.choice(sorted(others))]), "foreign"))
    declined = [r for _, r in told if (plain := fold(r)) and any(x in plain for x in refusals)]
    # Refusals in any language and to any prompt, rare ones as often as common ones.
    worded = sorted({skeleton(r): r for r in declined}.items()) + [(x, x) for x in refusals]
    for at in range(max(len(declined), len(told) // 3) if told else 0):
        text = worded[at % len(worded)][1]
        alike = asked_in.get(reader.languages.best(text, 2.0)) if random_.random() < 0.5 else None
        out.append((random_.choice(alike) if alike else told[random_.randrange(len(told))][0], text, "refusal"))
    return out


class Judge:
    """Trained on a bounded sample of (prompt, response), with the languages of all."""

    def __init__(self, sample: list[tuple[str, str]], languages: Languages, refusals: list[str] = REFUSALS):
        self.reader = Reader(languages)
        under: dict[str, set[str]] = {}
        for prompt, response in sample:
            under.setdefault(skeleton(response), set()).add(prompt)
        #: Wordings of at least three words that stand under at least CANNED different prompts.
        self.canned = {k for k, prompts in under.items() if len(prompts) >= CANNED and len(word_list(k)) >= 3}
        rows: list[list[list[tuple[int, float]]]] = []
        allowed: list[np.ndarray] = []
        for prompt, response in sample:
            if not says_nothing(response):
                parts, features = self.reader.read(prompt, response)
                rows.append(features)
                allowed.append(self._open_labels(prompt, response, parts, refusals))
        for prompt, response, label in planted(sample, self.reader, random.Random(SEED), refusals):
            parts, features = self.reader.read(prompt, response)
            labels = np.zeros((len(parts), len(LABELS)), dtype=bool)
            if label == "unfinished":
                labels[:-1, 0], labels[-1, 4] = True, True
            else:
                labels[:, LABELS.index(label)] = True
            rows.append(features)
            allowed.append(labels)
        for phrase in refusals:  # the list itself, each phrase as a clause
            parts, features = self.reader.read("", phrase)
            rows.append(features)
            allowed.append(np.tile(np.arange(len(LABELS)) == 1, (len(parts), 1)))
        self.field = ChainCRF(N_FEATURES, len(LABELS)).fit(rows, allowed)

    def _open_labels(self, prompt: str, response: str, parts: list[str], refusals: list[str]) -> np.ndarray:
        """The labels that the clauses of a response of the sample may have, as odds."""
        things = self._things(prompt)
        given, wanted = " ".join(re.findall(r"\w+", fold(prompt))), self.reader.wanted(prompt)
        out = np.zeros((len(parts), len(LABELS)))
        declined, brought = False, []
        for i, part in enumerate(parts):
            plain = fold(part)
            said = " ".join(re.findall(r"\w+", plain))
            own = self._things(part)
            held = len(own & things)
            structured = is_json(response) and part.lstrip("`json \n")[:1] in "{["
            brings = structured or any(c.isdigit() for c in part) or set(word_list(part)[:1]) & set(_YES_NO) or held >= 2 or (held > 0 and 2 * held >= len(own))
            brought.append(bool(brings))
            if any(x in plain for x in refusals):
                out[i, 1] = declined = True
                continue
            if declined and not brings:  # it belongs to the refusal before
                out[i, 1] = 1.0
                continue
            out[i, 0], out[i, 1] = 1.0, REFUSAL_ODDS * (not brings)
            out[i, 2] = not structured and bool(said) and said in given
            out[i, 3] = not structured and self.reader.languages.foreign(part, wanted) > 0
            # A title or another short line of its own is no broken sentence.
            broken = ending(part) in ("dots", "mark") or ending(part) == "word" and (len(said.split()) >= 6 or any(ending(x) == "end" for x in parts[:-1]))
            out[i, 4] = i == len(parts) - 1 and (_json_cut(response) if structured else broken)
        if not any(brought) and skeleton(response) in self.canned:
            out[:, :] = np.arange(len(LABELS)) == 1
        return out

    def _things(self, text: str) -> set[str]:
        """Words that are no names: in lower case, or known to a language."""
        return {w.lower() for w in re.findall(r"[^\W\d_]{4,}", text) if w.islower() or w.lower() in self.reader.languages.known}

    def coverage(self, prompt: str, response: str) -> tuple[dict[str, float], str]:
        """Share of the response under each tag, and the tag of its last clause."""
        parts, features = self.reader.read(prompt, response)
        tags = self.field.tag(features)
        size = np.array([max(1, len(p)) for p in parts], dtype=float)
        share = {name: float(size[tags == k].sum() / size.sum()) for k, name in enumerate(LABELS)}
        return share, LABELS[int(tags[-1])]

    def defect(self, prompt: str, response: str | None) -> str | None:
        if says_nothing(response):
            return "empty"
        share, last = self.coverage(prompt, response)
        if share["refusal"] >= 0.5:
            return "refusal"
        if share["echo"] >= 0.7:
            return "copy"
        if share["foreign"] > 0 and share["foreign"] >= share["answer"]:
            return "language"
        return "truncated" if last == "unfinished" else None


def answered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response) of every assistant message whose
    preceding turn is a user message with content."""
    role = F.regexp_replace(F.lower(F.trim(F.col("role"))), "[^a-z]", "")
    latest = (
        messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct("ingested_at", role.alias("role"), "content")).alias("m"))
        .select("conv_id", "turn", "m.role", "m.content")
    )
    asked = latest.filter(F.col("role").isin(*USER_ROLES)).select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("prompt"))
    said = latest.filter(F.col("role").isin(*ANSWER_ROLES)).select("conv_id", "turn", F.col("content").alias("response"))
    return said.join(asked, ["conv_id", "turn"])


@scratched
def defective_pairs(messages: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """One row (conv_id, turn, defect) per pair with a defect.

    Repeated deliveries of a turn count once (the latest); rows with null
    conversation, turn or role are no messages; a null prompt asks in no known
    language and copies nothing; a null response is empty. Long texts are read
    whole. An empty table gives no rows; other columns are ignored.
    """
    pairs = cut(answered(messages).withColumn("h", F.xxhash64("prompt", "response")))
    learnable = pairs.filter((F.length("prompt") + F.length("response")) <= TRAIN_CHARS)
    first = learnable.select("h").distinct().orderBy("h").limit(train_pairs)
    # Different pairs only, so that copies don't use the sample up; bounded by train_pairs and TRAIN_CHARS.
    sample = learnable.join(F.broadcast(first), "h").groupBy("h").agg(F.min(F.struct("prompt", "response")).alias("m")).select("h", "m.*").orderBy("h").collect()
    # As bytes with its code, so that executors need no copy of this package.
    shared = messages.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Judge([(r[1], r[2]) for r in sample], learn_languages(pairs))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = pickle.loads(shared.value)
        for pdf in batches:
            defect = [judge.defect(p or "", r) for p, r in zip(pdf["prompt"], pdf["response"])]
            out = pdf[["conv_id", "turn"]].assign(defect=defect)
            yield out[out["defect"].notna()]

    return pairs.select("conv_id", "turn", "prompt", "response").mapInPandas(run, "conv_id long, turn int, defect string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(load(spark, sf_dir, "chat_message"))


def p1_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs by defect and task."""
    messages = load(spark, sf_dir, "chat_message")
    task = messages.groupBy("conv_id", "turn").agg(F.max("task").alias("task"))
    return defective_pairs(messages).join(task, ["conv_id", "turn"]).groupBy("defect", "task").agg(F.count("*").alias("pairs"))


QUERIES = {"p1_found": p1_found, "p1_defect_counts": p1_defect_counts}
SQL: dict[str, str] = {}
