"""Votes for the language of a text by its function words."""

from __future__ import annotations

import re
from collections import Counter

# --- fixed values: function words; words that two languages share are left out of the votes ---

ENGLISH = "the of and to in is that it for on with as was be by this are at from or an have not which but they you were their been has would there when if will more no out so can what than other into could then these some do any my your i we our just only also how why where while each every before after because between should does did its it's don't i'm without get got over under both same such per via"
SPANISH = "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho cada cómo si es son está están puedo puede puedes tengo mi mis tu tus fue ser hace así cuál luego después aquí igual ella sino"
FRENCH = "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son cette aux mais comme on tout nous sa fait été aussi leur bien peut ces y ont ses être deux même si je vous ma mon mes votre vos c'est j'ai d'un d'une qu'il n'est alors donc car sans sous entre chaque puis ensuite avant après comment faut quand où là très encore leurs elle ils elles d'abord sinon"
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich du wir ihr mein meine mir mich dir dich kann können muss wenn dann weil damit jedes jeder jede zuerst sonst ohne unter zwischen welche wo warum doch hier diese dieser dieses ihre ihren gegen"

NAMES = {"en": ENGLISH, "es": SPANISH, "fr": FRENCH, "de": GERMAN}
STOPWORDS = {lang: frozenset(text.split()) for lang, text in NAMES.items()}
ANY_STOPWORD = frozenset().union(*STOPWORDS.values())

_uses = Counter(word for words in STOPWORDS.values() for word in words)
#: Words that only one of the languages has: they carry the vote.
VOTERS = {word: lang for lang, words in STOPWORDS.items() for word in words if _uses[word] == 1}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def tokens(text: str) -> list[str]:
    """Lower-cased words with their apostrophes, for the votes."""
    return [t.replace("’", "'") for t in _TOKEN.findall(text.lower())]


def votes(text: str) -> dict[str, int]:
    counted = Counter(VOTERS[t] for t in tokens(text) if t in VOTERS)
    return dict(counted)


def language(text: str, least: int = 3, margin: float = 2.0) -> str | None:
    """The language with the most votes, if it has ``least`` and ``margin`` times the next."""
    ranked = sorted(votes(text).items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < least:
        return None
    if len(ranked) > 1 and ranked[0][1] < margin * ranked[1][1]:
        return None
    return ranked[0][0]
