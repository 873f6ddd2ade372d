"""Character classes that read alike in Java and RE2 regular expressions.

``\\w`` and ``\\s`` differ between engines, so every rule here spells its class
out. Multiline rules use ``(?md)`` on the Spark side: only ``\\n`` ends a line.
"""

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
NOT_NAME = f"[^{WORD}{SPACE}-]"
EDGES = f"^[{SPACE}]+|[{SPACE}]+$"
RUNS = f"[-{SPACE}]+"
HEADING = rf"(?md)^#{{1,2}}[{SPACE}]+(.+)$"
TAG = "<[^>]+>"
EMPHASIS = "[*_`]"
NAME_WORD = rf"[A-Z][{WORD}.'-]+"
COPYRIGHT = (
    rf"©[{SPACE}]*(\p{{Nd}}{{4}})[{SPACE}]+by[{SPACE}]+"
    rf"({NAME_WORD}(?:[{SPACE}]+{NAME_WORD}){{0,3}})"
)
YEAR_SIGN = rf"©[{SPACE}]*(\p{{Nd}}{{4}})"
YEAR_WORD = rf"(?d)(?:^|[^{WORD}])Copyright(?:$|[^{WORD}].{{0,9}}?|)(\p{{Nd}}{{4}})"
EXTENSION = r"(?s)^(\.*[^.].*)\.[^.]*$"
