"""How submissions name their forms and the parts of them.

Fixed values. Every pattern is for a line without white space at its ends; where
several match, the first in order decides. Quotes round a form's letter may be
straight, curly or angular.
"""

from __future__ import annotations

_Q = "[\"«»\\u201c\\u201d\\u2018\\u2019]"
_BUILDING = r"Confidence[-\s]Building\s+Measure"
_CONFIANCE = r"MESURE\s+DE\s+CONFIANCE"
_CONFIANZA = r"Medida\s+de\s+fomento\s+de\s+la\s+confianza"


def _quoted(title: str, letter: str, rest: str) -> str:
    return rf"{title}\s*{_Q}?\s*{letter}\s*{_Q}?{rest}"


def _letter(form: str, *titles: str) -> list[tuple[str, str]]:
    """The headings that forms B to G share, and the titles of their own."""
    return [
        (form, rf"Form\s+{form}\b"),
        (form, rf"Confidence\s+Building\s+Measure\s+{form}\b"),
        (form, _quoted(_BUILDING, form, r"\b")),
        (form, _quoted(_CONFIANCE, form, r"\b")),
        (form, _quoted(_CONFIANZA, form, r"\b")),
        (form, rf"Formulaire\s+{form}\b"),
        *((form, title) for title in titles),
    ]


def _part(n: int, *titles: str) -> list[tuple[str, str]]:
    """The headings of the two parts of form A, and the titles of their own."""
    form = f"A{n}"
    return [
        (form, rf"Form\s+A,?\s+[Pp]art\s+{n}\b"),
        (form, rf"Confidence\s+Building\s+Measure\s+A,?\s+Part\s+{n}\b"),
        (form, _quoted(_BUILDING, "A", rf"\s*[,:]?\s*Part\s*{n}\b")),
        (form, _quoted(_CONFIANCE, "A", rf"\s*[,:]?\s*Partie\s*{n}\b")),
        (form, rf"Formulaire\s+A\s*[-–]\s*Partie\s*{n}\b"),
        (form, _quoted(_CONFIANZA, "A", rf"\s*[,:]?\s*Parte\s*{n}\b")),
        *((form, title) for title in titles),
    ]


#: (form, pattern): lines with which a form begins, in English, French, Spanish and Russian.
FORM_ANCHORS: list[tuple[str, str]] = [
    ("0", r"Declaration\s+form\s+on\s+Nothing"),
    ("0", r"Nothing\s+to\s+Declare\s+or\s+Nothing\s+New\s+to\s+Declare"),
    *_part(1, r"Part\s*1\s+Exchange\s+of\s+data\s+on\s+research", r"Exchange\s+of\s+data\s+on\s+research\s+centres"),
    *_part(2, r"Part\s*2\s+Exchange\s+of\s+information\s+on\s+national", r"National\s+biological\s+de[fe]ence\s+research\s+and\s+development"),
    *_letter("B", r"Exchange\s+of\s+information\s+on\s+outbreaks", r"Information\s+on\s+outbreaks\s+of\s+infectious", r"Background\s+information\s+on\s+outbreaks"),
    *_letter("C", r"Encouragement\s+of\s+publication\s+of\s+results"),
    *_letter("E", r"Formule\s*E\b", r"Declaration\s+of\s+legislation[,\s]"),
    *_letter("F", r"Declaration\s+of\s+past\s+activities\s+in\s+offensive"),
    *_letter("G", r"Declaration\s+of\s+vaccine\s+production\s+facilities"),
    ("A1", r"Форма\s+[Aa],?\s+часть\s+1\b"),
    ("A2", r"Форма\s+[Aa],?\s+часть\s+2\b"),
    *((form, rf"Форма\s+{form}\b") for form in "BCEFG"),
    ("A1", r"Measure\s+A,?\s+Part\s+1\b"),
    ("A2", r"Measure\s+A,?\s+Part\s+2\b"),
    *((form, rf"Measure\s*{form}\b") for form in "BCEFG"),
    ("A1", _quoted(rf"\d+\.\s+{_BUILDING}", "A", "")),
    *((form, _quoted(rf"\d+\.\s+{_BUILDING}", form, r"\b")) for form in "BCEFG"),
]
#: (form, pattern): the same anywhere in two lines in a row, where letter and part are apart.
FORM_PAIRS: list[tuple[str, str]] = [
    ("A1", _quoted(_BUILDING, "A", r"\s+Part\s*1\b")),
    ("A2", _quoted(_BUILDING, "A", r"\s+Part\s*2\b")),
    ("A1", _quoted(_CONFIANCE, "A", r"\s+Partie\s*1\b")),
    ("A2", _quoted(_CONFIANCE, "A", r"\s+Partie\s*2\b")),
    ("A1", _quoted(_CONFIANZA, "A", r"\s+Parte\s*1\b")),
    ("A2", _quoted(_CONFIANZA, "A", r"\s+Parte\s*2\b")),
    ("A2", _quoted(_BUILDING, "A", r".*Part\s*2\b")),
    ("A1", _quoted(_BUILDING, "A", r".*Part\s*1\b")),
]
FORM_ANCHORS, FORM_PAIRS = ([(form, f"(?iU){pattern}") for form, pattern in some] for some in (FORM_ANCHORS, FORM_PAIRS))  # in any case, \b and \s in any script
#: Lines with which a record within a form begins: facilities of A1, vaccine facilities of G, programmes and facilities of A2.
FACILITY = r"^(?:1\.\s+(?:Name|Nom|Nombre)\b|\d+\.\s+Наименование\s+объекта)"
VACCINE_FACILITY = r"^1\.\s+(?:Name of facility|Nom de l'installation|Nombre de la instalaci[oó]n)\b"
PROGRAMME = r"^1\.\s+State the objectives"
DEFENCE_FACILITY = r"^1\.\s+What is the name of the facility"
#: Fields at which long records of A2 are shortened, and the characters kept: of objectives before the funding, and of the description of work.
FUNDING = r"(?m)^2\.\s+State the total funding"
PUBLICATIONS = r"(?m)^\((?:viii|ix)\)\s+Provide a list of publicly"
WORK = r"(?m)^5\.\s+Briefly describe the biological defence work"
OBJECTIVES_MOST, WORK_MOST = 2000, 1500
#: Characters before a programme's first field that hold its heading; characters of a chunk of A2.
PROGRAMME_LOOKBACK, A2_CHUNK = 400, 12000
