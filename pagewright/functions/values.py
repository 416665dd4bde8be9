"""Symbols, word lists, patterns and replacements that results depend on.

Patterns are Java's. ``(?U)`` gives Unicode classes, ``(?d)`` keeps line ends to line feeds.
"""

RADIO, UNCHECKED, CHECKED = "○", "☐", "☑"

CURLY = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "―": "-", " ": " "}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}

NOISE_CHARS = ["|", "~", "`", "^", "\x00"]
RADIO_TEXTS = ["O", "o", "0", "Oo", "oO", "OO", "oo", "()", "[]", "C", "Q", "G", "©", "®", "™", "¢"]
USEFUL_SINGLES = list("aeiouAEIOUyY0123456789OoXx=()[]{}:;.,+-*/\"'")

# Beginnings of words with O and o that are no circle sign, and whole words with Or and or that are none.
O_BEGINNINGS = [
    "Ob", "Oc", "Of", "Oh", "Oi", "Oj", "Ok", "Ol", "Om", "On", "Op", "Oq", "Os", "Ou", "Ov", "Ow", "Ox", "Oy", "Oz",
    "ob", "oc", "od", "of", "oh", "oi", "oj", "ok", "ol", "om", "on", "op", "oq", "os", "ou", "ov", "ow", "ox", "oy", "oz",
    "Ot", "ot",
]
OR_WORDS = [
    "Orden", "orden", "Ordena", "ordena", "Ordenar", "ordenar", "Ordenado", "ordenado", "Ordenamiento", "ordenamiento",
    "Origen", "origen", "Original", "original", "Orientación", "orientación", "Orientado", "orientado", "Oración", "oración",
    "Organizar", "organizar", "Organización", "organización", "Oro", "oro",
]
#: Second letters of the former by their first, and the latter without their first letter: what patterns are made of.
AFTER_BIG_O, AFTER_SMALL_O = ("".join(sorted(x[1] for x in O_BEGINNINGS if x[0] == o)) for o in "Oo")
SAFE_STEMS = list(dict.fromkeys(x[1:] for x in OR_WORDS))

#: All Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

QUESTION_HEAD = r"(?iuU)^\s*(Pregunta\s+\d+|\d{1,3}[.)\-]\s+[A-ZÁÉÍÓÚÑ¿¡]|Q\d{1,3}[.:)]\s)"
OPTION_LINE = r"(?U)^\s*([○☐☑]|[a-dA-D][).])\s"

CODE_PATTERNS = [
    r"^(if|elif|else|for|while|def|class|return|import|from|try|except|finally|with)\b",
    r"^[a-z_]\w*\s*=\s*",
    r"^\w+\(.*\)",
    r"print\s*\(",
    r"input\s*\(",
    r"^\s*#\s*\w",
    r"\brange\s*\(",
    r"\blen\s*\(",
    r"\bint\s*\(",
    r"\bstr\s*\(",
    r"\bfloat\s*\(",
    r"\blist\s*\(",
    r"\bdict\s*\(",
    r"\b(True|False|None)\b",
    r"^\s*\w+\s*\[.*\]\s*=",
    r"\{\s*$",
    r"^\s*\}",
    r";\s*$",
    r"^\s*(var|let|const|int|float|double|string|char|void|public|private|static)\s",
    r"System\.out",
    r"Console\.(Write|Read)",
    r"cout\s*<<",
    r"cin\s*>>",
    r"printf\s*\(",
    r"scanf\s*\(",
]
CODE_OPERATORS = ["==", ">=", "<=", "!=", "= input(", "print(", "+=", "-=", "*=", "/=", "%=", "=>", "->"]

#: Ordered repairs of a whole text: pattern, replacement.
CODE_TOKENS = [(r"\bIst\b", "lst"), (r"\bIen\b", "len"), (r"\b(iflint|ifllint)\b", "if(int"), (r"\b(prinl|printt)\b", "print"), (r"\binpul\b", "input")]
GENDER = [(r"Genero\s*\(M/P\)", "Genero (M/F)"), (r"\(M/P\)", "(M/F)")]
GLUED = [(r"\besun\b", "es un"), (r"\besuna\b", "es una"), (r"\bnoexiste\b", "no existe"), (r"\bnoes\b", "no es"), (r"\bdela\b", "de la"), (r"\bdelos\b", "de los"), (r"\bporquees\b", "porque es")]
ACCENTS = [(r"\bdiferencía\b", "diferencia"), (r"\bfuncíón\b", "función"), (r"\boperacíón\b", "operación"), (r"\bcondícíón\b", "condición"), (r"\bvaríable\b", "variable")]
DIGITS = [(r"(?<=\d)l(?=\d)", "1"), (r"(?<=\d)O(?=\d)", "0")]
RUNS = [(r"\.{10,}", "..."), (r"-{10,}", "─" * 10), (r"_{10,}", "_" * 10)]

RULE_WIDTH, PREVIEW_LINES = 50, 15
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif", ".bmp"]
FORMATS = ["txt", "json", "docx", "all"]
NO_TEXT = "[Sin texto detectado]"
EARLY_STOP = 2400.0
