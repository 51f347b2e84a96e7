"""Distribution functions as SQL expressions, by positive-term series over lgamma."""


def _gamma_p(a: str, x: str, terms: int) -> str:
    """Regularised lower incomplete gamma P(a, x) for x > 0."""
    return (
        f"list_sum(list_transform(range(0, {terms}), lambda i: "
        f"exp(-({x}) + (({a}) + i) * ln({x}) - lgamma(({a}) + i + 1))))"
    )


def chi2_sf(x: str, df: str, terms: int = 1500) -> str:
    return (
        f"(CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 1200 THEN 0.0 "
        f"ELSE greatest(0.0, 1.0 - {_gamma_p(f'({df}) / 2.0', f'({x}) / 2.0', terms)}) END)"
    )


def norm_two_sided(z: str) -> str:
    return chi2_sf(f"({z}) * ({z})", "1.0")


def _beta_inc(a: str, b: str, x: str, terms: int) -> str:
    return (
        f"list_sum(list_transform(range(0, {terms}), lambda i: exp((({a}) + i) * ln({x}) + ({b}) * ln(1 - ({x})) "
        f"+ lgamma(({a}) + ({b}) + i) - lgamma({b}) - lgamma(({a}) + i + 1))))"
    )


def t_two_sided(t: str, df: str, terms: int = 3000) -> str:
    t2 = f"(({t}) * ({t}))"
    inc = _beta_inc("0.5", f"({df}) / 2.0", f"{t2} / (({df}) + {t2})", terms)
    return f"(CASE WHEN {t2} = 0 THEN 1.0 WHEN {t2} > 2000 THEN 0.0 ELSE greatest(0.0, 1.0 - {inc}) END)"


def f_sf(f: str, d1: str, d2: str, terms: int = 3000) -> str:
    inc = _beta_inc(f"({d1}) / 2.0", f"({d2}) / 2.0", f"({d1}) * ({f}) / (({d2}) + ({d1}) * ({f}))", terms)
    return f"(CASE WHEN ({f}) <= 0 THEN 1.0 WHEN ({d1}) * ({f}) > 2000 THEN 0.0 ELSE greatest(0.0, 1.0 - {inc}) END)"


# Coefficients of the published algorithm AS241 (percentage points of the normal
# distribution), highest power first: centre and flank, numerator and denominator.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_FLANK = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)


def _ratio(parts, x: str) -> str:
    """Quotient of two polynomials in x by Horner's rule."""
    forms = []
    for coefficients in parts:
        form = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            form = f"({form} * {x} + {c!r}::DOUBLE)"
        forms.append(form)
    return f"({forms[0]} / {forms[1]})"


def norm_ppf(p: str) -> str:
    """Inverse of the normal distribution function for p from 1e-10 to 1 - 1e-10."""
    near = _ratio(_CENTRE, f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))")
    far = _ratio(_FLANK, f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)")
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {near} ELSE sign({p} - 0.5) * {far} END)"
