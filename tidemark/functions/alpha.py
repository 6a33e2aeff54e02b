"""The 158-factor library, generated by rule: 9 candle shapes, 4 price ratios, and 29 families over five windows."""

from __future__ import annotations

WINDOWS = (5, 10, 20, 30, 60)

#: Candle shapes and price ratios.
FIXED = {
    "KMID": "(C - O) / O",
    "KLEN": "(H - L) / O",
    "KMID2": "(C - O) / (H - L + 1e-12)",
    "KUP": "(H - MAX(O, C)) / O",
    "KUP2": "(H - MAX(O, C)) / (H - L + 1e-12)",
    "KLOW": "(MIN(O, C) - L) / O",
    "KLOW2": "(MIN(O, C) - L) / (H - L + 1e-12)",
    "KSFT": "(2 * C - H - L) / O",
    "KSFT2": "(2 * C - H - L) / (H - L + 1e-12)",
    "OPEN0": "O / C",
    "HIGH0": "H / C",
    "LOW0": "L / C",
    "VWAP0": "BARVWAP / C",
}

#: Families by window n.
FAMILIES = {
    "ROC": "REF(C, {n}) / C",
    "MA": "MA(C, {n}) / C",
    "STD": "STDDEV_SAMPLE(C, {n}) / C",
    "BETA": "SLOPE(C, {n}) / C",
    "RSQR": "RSQUARE(C, {n})",
    "RESI": "RESI(C, {n}) / C",
    "MAX": "HHV(H, {n}) / C",
    "MIN": "LLV(L, {n}) / C",
    "QTLU": "QUANTILE(C, {n}, 0.8) / C",
    "QTLD": "QUANTILE(C, {n}, 0.2) / C",
    "RANK": "RANK_PCT(C, {n})",
    "RSV": "(C - LLV(L, {n})) / (HHV(H, {n}) - LLV(L, {n}) + 1e-12)",
    "IMAX": "(MAXINDEX(H, {n}) + 1) / {n}",
    "IMIN": "(MININDEX(L, {n}) + 1) / {n}",
    "IMXD": "(MAXINDEX(H, {n}) - MININDEX(L, {n})) / {n}",
    "CORR": "CORREL(C, LN(V + 1), {n})",
    "CORD": "CORREL(C / REF(C, 1), LN(V / REF(V, 1) + 1), {n})",
    "CNTP": "MA(UP, {n})",
    "CNTN": "MA(DOWN, {n})",
    "CNTD": "MA(UP, {n}) - MA(DOWN, {n})",
    "SUMP": "SUM(GAIN, {n}) / (SUM(MOVE, {n}) + 1e-12)",
    "SUMN": "SUM(LOSS, {n}) / (SUM(MOVE, {n}) + 1e-12)",
    "SUMD": "(SUM(GAIN, {n}) - SUM(LOSS, {n})) / (SUM(MOVE, {n}) + 1e-12)",
    "VMA": "MA(V, {n}) / (V + 1e-12)",
    "VSTD": "STDDEV_SAMPLE(V, {n}) / (V + 1e-12)",
    "WVMA": "STDDEV_SAMPLE(HEAT, {n}) / (MA(HEAT, {n}) + 1e-12)",
    "VSUMP": "SUM(VGAIN, {n}) / (SUM(VMOVE, {n}) + 1e-12)",
    "VSUMN": "SUM(VLOSS, {n}) / (SUM(VMOVE, {n}) + 1e-12)",
    "VSUMD": "(SUM(VGAIN, {n}) - SUM(VLOSS, {n})) / (SUM(VMOVE, {n}) + 1e-12)",
}

PRELUDE = (
    "D := C - REF(C, 1); UP := IF(ISNA(D) > 0, DRAWNULL, D > 0); DOWN := IF(ISNA(D) > 0, DRAWNULL, D < 0); GAIN := MAX(D, 0); LOSS := MAX(0 - D, 0); MOVE := ABS(D); "
    "VD := V - REF(V, 1); VGAIN := MAX(VD, 0); VLOSS := MAX(0 - VD, 0); VMOVE := ABS(VD); HEAT := ABS(C / REF(C, 1) - 1) * V; "
)


def alpha158(windows: tuple[int, ...] = WINDOWS, families: tuple[str, ...] = tuple(FAMILIES), fixed: bool = True) -> str:
    """The library, or some windows or families of it, as one formula with an output a factor."""
    parts = [f"F_{k} : {v};" for k, v in FIXED.items()] if fixed else []
    parts += [f"F_{k}{n} : {v.format(n=n)};" for k, v in FAMILIES.items() if k in families for n in windows]
    return PRELUDE + " ".join(parts)


#: The formulaic alphas of the published list of 101 that need one series only. VW stands for the volume-weighted price.
ALPHA101 = {
    6: "-1 * CORREL(O, V, 10)",
    7: "IF(MA(V, 20) < V, -1 * RANK_PCT(ABS(MOM(C, 7)), 60) * SIGN(MOM(C, 7)), -1)",
    9: "IF(0 < LLV(D, 5), D, IF(HHV(D, 5) < 0, D, -1 * D))",
    12: "-1 * SIGN(V - REF(V, 1)) * D",
    21: "IF(MA(C, 8) + STDDEV_SAMPLE(C, 8) < MA(C, 2), -1, IF(MA(C, 2) < MA(C, 8) - STDDEV_SAMPLE(C, 8), 1, IF(V / MA(V, 20) >= 1, 1, -1)))",
    23: "IF(MA(H, 20) < H, -1 * MOM(H, 2), 0)",
    24: "IF(MOM(MA(C, 100), 100) / REF(C, 100) <= 0.05, -1 * (C - LLV(C, 100)), -1 * MOM(C, 3))",
    26: "-1 * HHV(CORREL(RANK_PCT(V, 5), RANK_PCT(H, 5), 5), 3)",
    35: "RANK_PCT(V, 32) * (1 - RANK_PCT(C + H - L, 16)) * (1 - RANK_PCT(C / REF(C, 1) - 1, 32))",
    41: "(H * L) ^ 0.5 - VW",
    43: "RANK_PCT(V / MA(V, 20), 20) * RANK_PCT(-1 * MOM(C, 7), 8)",
    46: "IF(0.25 < BEND, -1, IF(BEND < 0, 1, -1 * D))",
    49: "IF(BEND < -0.1, 1, -1 * D)",
    51: "IF(BEND < -0.05, 1, -1 * D)",
    53: "-1 * MOM((2 * C - L - H) / (C - L), 9)",
    54: "-1 * (L - C) * O ^ 5 / ((L - H) * C ^ 5)",
    101: "(C - O) / (H - L + 0.001)",
}


def alpha101(numbers: tuple[int, ...] = tuple(ALPHA101)) -> str:
    """Some of the alphas as one formula, an output each."""
    shared = "D := C - REF(C, 1); VW := BARVWAP; BEND := (REF(C, 20) - REF(C, 10)) / 10 - (REF(C, 10) - C) / 10; "
    return shared + " ".join(f"ALPHA{n} : {ALPHA101[n]};" for n in numbers)
