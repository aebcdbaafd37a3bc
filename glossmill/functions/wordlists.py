"""English function words by word class; longer lists are a parameter."""

from __future__ import annotations

#: The closed word classes of English, from general grammars; no list of another engine is meant.
CLASSES = {
    "determiners": "a an the this that these those each every either neither some any no all both half such what which whose other another",
    "pronouns": "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom one",
    "prepositions": "about above across after against along among around at before behind below beneath beside between beyond by despite down during except for from in inside into like near of off on onto out outside over past per since through throughout to toward towards under until up upon via with within without",
    "conjunctions": "and but or nor so yet if because although though unless while whereas whether as than",
    "auxiliaries": "am is are was were be been being have has had having do does did doing done can could may might must shall should will would ought cannot",
    "adverbs": "not too very just only also again then there here when where why how ever never once",
    "clitics": "'s 're 've 'll 'd 'm n't",
    "brackets": "-lrb- -rrb- -lsb- -rsb- -lcb- -rcb-",
}


def function_words() -> frozenset[str]:
    """The words of all classes, in lower case."""
    return frozenset(w for words in CLASSES.values() for w in words.split())


def read_words(path: str) -> frozenset[str]:
    """The words of a list file, one or more a line, in lower case; any list may stand in for the classes."""
    with open(path, encoding="utf-8") as f:
        return frozenset(f.read().lower().split())


def stop_words(extra: str | None = None) -> frozenset[str]:
    """Function words and the words of the list file ``extra``."""
    return function_words() if extra is None else function_words() | read_words(extra)
