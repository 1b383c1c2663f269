"""First of many patterns that a text matches, by literals that its matches must hold.

The module is shipped with the functions that use it, so workers need no copy of the package.
"""

import re

import ahocorasick

# The letters beyond ASCII that match an ASCII letter when case is ignored.
FOLDED = {0x017F: "s", 0x0130: "i", 0x0131: "i", 0x212A: "k"}
# Shorter literals hardly rule anything out.
LEAST_LITERAL = 3
PLAIN = re.compile(r"[A-Za-z0-9 _/@#%&=:;,'\"<>!~`-]")


def demanded(pattern: str) -> str | None:
    """The longest literal, in lower case, that every match of a pattern holds; None where none is plain to see.

    Only patterns without groups, classes and alternatives are looked at; a character before a
    quantifier is not demanded.
    """
    if re.search(r"[|()\[\]]", pattern):
        return None
    runs, run, i = [], "", 0
    while i < len(pattern):
        size = 2 if pattern[i] == "\\" else 1
        token, after = pattern[i : i + size], pattern[i + size : i + size + 1]
        i += size
        literal = token if PLAIN.fullmatch(token) else token[1] if size == 2 and token[1:] in list(".^$*+?{}\\") else None
        if literal is None or after in ("*", "?", "{"):
            runs, run = [*runs, run], ""
        else:
            run += literal
            if after == "+":
                runs, run = [*runs, run], ""
    longest = max([*runs, run], key=len)
    return longest.lower() if len(longest) >= LEAST_LITERAL else None


class Matcher:
    """Patterns in order; hints are lower-case ASCII literals of which every match holds one."""

    def __init__(self, patterns: list[tuple[str, tuple[str, ...]]]):
        self.patterns = [re.compile(p, re.IGNORECASE) for p, _ in patterns]
        self.always, by_literal = [], {}
        for i, (pattern, hints) in enumerate(patterns):
            found = hints or tuple(filter(None, [demanded(pattern)]))
            if not found or not all(h.isascii() for h in found):
                self.always.append(i)
                continue
            for literal in found:
                by_literal.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, rules in by_literal.items():
            self.automaton.add_word(literal, rules)
        self.automaton.make_automaton()
        self.any_literal = bool(by_literal)

    def first(self, text: str | None) -> int:
        """Number of the first pattern that is found in a text; -1 for none."""
        if text is None:
            return -1
        possible = set(self.always)
        if self.any_literal:
            folded = (text if text.isascii() else text.translate(FOLDED)).lower()
            for _, rules in self.automaton.iter(folded):
                possible.update(rules)
        for i in sorted(possible):
            if self.patterns[i].search(text):
                return i
        return -1
