"""Hand-written lexicon for the rule cases (the real one is an input)."""

from grantmill.operators.lexicon import Lexicon, Term

FA, INT, ARD, CARE, SOC = (
    "fundamental_aging", "intervention", "age_related_disease", "care", "social_population_aging",
)


def small_lexicon() -> Lexicon:
    kw = [
        ("cellular senescence", FA, 0.9, None), ("senescen*", FA, 0.8, None), ("lifespan", FA, 0.7, None),
        ("superlongevous", FA, 0.55, None), ("longevity", FA, 0.6, None),
        ("metformin", INT, 0.65, None), ("rapamycin", INT, 0.7, None), ("senolytic*", INT, 0.8, None),
        ("geroprotector*", INT, 0.9, None), ("exercise intervention*", INT, 0.6, None),
        ("alzheimer*", ARD, 0.9, None), ("tau", ARD, 0.6, None), ("childhood cancer", ARD, 0.5, None),
        ("elderly care", CARE, 0.9, None), ("nursing home*", CARE, 0.7, None),
        ("retirement", SOC, 0.7, "anchor"), ("pension*", SOC, 0.6, "anchor"),
    ]
    terms = [Term(t, "keyword", c, "en", w, r) for t, c, w, r in kw]
    terms += [Term("cellulär* åldrande", "keyword", FA, "sv", 0.8), Term("nad+", "keyword", FA, "en", 0.62)]
    terms += [
        Term("loneliness", "conditional", SOC, "en", 0.3, "anchor"),
        Term("participation", "conditional", SOC, "en", 0.25, "anchor"),
        Term("exercise", "conditional", INT, "en", 0.2, "dev_cues"),
    ]
    terms += [Term(t, "anchor") for t in ("ageing", "aging", "older adults", "elderly")]
    terms += [Term("åldrande", "anchor", lang="sv"), Term("machine", "trap", FA)]
    return Lexicon.of(terms).with_gate_terms()
