"""Registered queries of the time-series library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import alpha, candles, extra, library  # noqa: F401  fill the registry
from tidemark.plans import recursions, studies
from tidemark.plans.formula import DUCK, MARKET, Compiler
from tidemark.plans.run import eval_formula
from tidemark.sources.bars import EVENT_BARS_SQL, event_bars

#: Formula queries: every output is one function, by its own name.
FORMULAS: dict[str, str] = {
    "formula_moving_average_cross": "MA5 := MA(CLOSE, 5); MA20 := MA(CLOSE, 20); FAST : MA5; SLOW : MA20; GOLD : CROSS(MA5, MA20); DEAD : CROSSDOWN(MA5, MA20); BULL : MA5 > MA20 AND CLOSE > MA5;",
    "fn_arithmetic": "F_ADD : ADD(O, C); F_SUB : SUB(H, L); F_MULT : MULT(C, V); F_DIV : DIV(C, O); F_MOD : MOD(C, 7); F_REM : C % 7; F_POW : POW(C / 100, 2); F_HAT : (C / 100) ^ 2; F_NEG : -2 ^ 2 + C; F_MAX : MAX(O, C); F_MIN : MIN(O, C); F_AVG : AVG(O, H, L, C); F_SIGN : SIGN(C - O); F_ABS : ABS(C - O);",
    "fn_math": "F_SIN : SIN(C); F_COS : COS(C); F_TAN : TAN(C / 1000); F_ATAN : ATAN(C); F_ASIN : ASIN((C - O) / 100); F_ACOS : ACOS((C - O) / 100); F_SINH : SINH(C / 100); F_COSH : COSH(C / 100); F_TANH : TANH(C / 100); F_EXP : EXP(C / 100); F_LN : LN(C); F_LOG10 : LOG10(C); F_SQRT : SQRT(C - O); F_ROUND : ROUND(C - O); F_INTPART : INTPART(C - O); F_FRACPART : FRACPART(C - O); F_CEIL : CEIL(C); F_FLOOR : FLOOR(C); F_CEILING : CEILING(C, 5);",
    "fn_logic": "F_IF : IF(C > O, H, L); F_IFTHEN : IFTHEN(C > O, H); F_AND : C > O AND V > 10; F_OR : C > O OR V > 30; F_XOR : (C > O) XOR (V > 20); F_NOT : NOT(C > O); F_EQ : V = 20; F_NE : V <> 20; F_BETWEEN : BETWEEN(C, 50, 150); F_RANGE : RANGE(C, 50, 150); F_ISNA : ISNA(REF(C, 3)); F_THEN : IF C > O THEN H ELSE L;",
    "fn_price": "F_AVGPRICE : AVGPRICE(O, H, L, C); F_MEDPRICE : MEDPRICE(H, L); F_TYPPRICE : TYPPRICE(H, L, C); F_WCLPRICE : WCLPRICE(H, L, C); F_BOP : BOP(O, H, L, C); F_MARKETFI : MARKETFI(H, L, V);",
    "fn_clock": "F_YEAR : YEAR; F_MONTH : MONTH; F_DAY : DAY; F_HOUR : HOUR; F_MINUTE : MINUTE; F_DATE : DATE; F_TIME : TIME; F_WEEKDAY : WEEKDAY; F_FROMOPEN : FROMOPEN;",
    "fn_lag": "F_REF : REF(C, 3); F_OPEN1 : OPEN1; F_HIGH1 : HIGH1; F_LOW1 : LOW1; F_CLOSE1 : CLOSE1; F_VOL1 : VOL1; F_MOM : MOM(C, 5); F_ROC : ROC(C, 5); F_ROCP : ROCP(C, 5); F_ROCR : ROCR(C, 5); F_ROCR100 : ROCR100(C, 5); F_TR : TR(H, L, C); F_TRANGE : TRANGE(H, L, C); F_RS : RELATIVE_STRENGTH(C, O, 5); F_LIMIT_UP : LIMIT_UP(C, 0.5); F_LIMIT_DOWN : LIMIT_DOWN(C, 0.5);",
    "fn_cross": "M3 := MA(C, 3); M9 := MA(C, 9); F_CROSS : CROSS(M3, M9); F_DOWN : CROSSDOWN(M3, M9); F_LEVEL : CROSS(C, 100); F_LONG : LONGCROSS(M3, M9, 3);",
    "fn_rolling": "F_MA : MA(C, 20); F_SUM : SUM(V, 20); F_HHV : HHV(H, 20); F_LLV : LLV(L, 20); F_STD : STD(C, 20); F_STDDEV : STDDEV(C, 20, 2); F_SAMPLE : STDDEV_SAMPLE(C, 20); F_VAR : VAR(C, 20); F_MIDPOINT : MIDPOINT(C, 14); F_SPAN : ROLLING_RANGE(C, 14); F_ZSCORE : ZSCORE(C, 20); F_NESTED : MA(MA(C, 5), 9);",
    "fn_conditions": "UP := C > O; F_COUNT : COUNT(UP, 10); F_EXIST : EXIST(C > 200, 10); F_EVERY : EVERY(C > 20, 5); F_LAST : LAST(C > 20, 5, 2); F_BARSLAST : BARSLAST(C > 150); F_SINCE : BARSSINCE(C > 150); F_RUN : BARSLASTCOUNT(UP); F_WHEN : VALUEWHEN(C > 150, H); F_FIX : FIXNAN(IF(C > 100, C, DRAWNULL));",
    "fn_moments": "F_SKEW : SKEW(C, 10); F_KURT : KURT(C, 10); F_AVEDEV : AVEDEV(C, 10); F_DEVSQ : DEVSQ(C, 10); F_CORREL : CORREL(H, L, 10); F_COVAR : COVAR(H, L, 10); F_HISTVOL : HISTVOL(C, 20);",
    "fn_bands": "F_BOLL : BOLL(C, 20, 2); F_BOLLUP : BOLLUP(C, 20, 2); F_BOLLDN : BOLLDN(C, 20, 2); F_BOLLWIDTH : BOLLWIDTH(C, 20, 2); F_DONCHIAN : DONCHIAN(H, L, 20); F_WIDTH : DONCHIAN_WIDTH(H, L, 20); F_TENKAN : TENKAN(H, L, 9); F_KIJUN : KIJUN(H, L, 26); F_MIDPRICE : MIDPRICE(H, L, 14);",
    "fn_oscillators": "F_WILLR : WILLR(H, L, C, 14); F_STOCH : STOCH(H, L, C, 14, 3); F_STOCHF : STOCHF(H, L, C, 14); F_CCI : CCI(H, L, C, 14); F_CMO : CMO(C, 14); F_MFI : MFI(H, L, C, V, 14); F_PSY : PSY(C, 12); F_BIAS : BIAS(C, 6); F_APO : APO(C, 12, 26); F_PPO : PPO(C, 12, 26); F_DPO : DPO(C, 20); F_ULTOSC : ULTOSC(H, L, C, 7, 14, 28); F_IMI : IMI(O, C, 14); F_QSTICK : QSTICK(O, C, 8);",
    "fn_trend": "F_ER : ER(C, 10); F_VHF : VHF(C, 14); F_CHOP : CHOP(H, L, C, 14); F_VPLUS : VORTEX_PLUS(H, L, C, 14); F_VMINUS : VORTEX_MINUS(H, L, C, 14); F_AROON_UP : AROON_UP(H, L, 14); F_AROON_DN : AROON_DN(H, L, 14); F_AROONOSC : AROONOSC(H, L, 14); F_AO : AO(H, L, 5, 34); F_AC : AC(H, L, 5, 34, 5); F_ADR : ADR(H, L, 14);",
    "fn_volume": "F_OBV : OBV(C, V); F_AD : AD(H, L, C, V); F_CMF : CMF(H, L, C, V, 20); F_VWAP : VWAP(H, L, C, V); F_PVT : PVT(C, V); F_WAD : WAD(H, L, C); F_RVOL : RVOL(V, 20); F_SURGE : VOLUME_SURGE(V, 10, 1.2); F_BREAKOUT : BREAKOUT(C, H, 20); F_BREAKDOWN : BREAKDOWN(C, L, 20); F_COPPOCK : COPPOCK(C, 14, 11, 10);",
    "fn_weighted": "F_WMA : WMA(C, 10); F_HMA : HMA(C, 16); F_ALMA : ALMA(C, 9, 0.85, 6); F_TRIMA : TRIMA(C, 10); F_TRIMA_ODD : TRIMA(C, 9); F_VWMA : VWMA(C, V, 20);",
    "fn_regression": "F_SLOPE : SLOPE(C, 14); F_LINEARREG : LINEARREG(C, 14); F_ICEPT : LINEARREG_INTERCEPT(C, 14); F_ANGLE : LINEARREG_ANGLE(C, 14); F_TSF : TSF(C, 14); F_RESI : RESI(C, 14); F_FOSC : FOSC(C, 14); F_RSQUARE : RSQUARE(C, 14);",
    "fn_extremes": "F_HHVBARS : HHVBARS(H, 10); F_LLVBARS : LLVBARS(L, 10); F_MAXINDEX : MAXINDEX(C, 10); F_MININDEX : MININDEX(C, 10); F_RANK : RANK(C, 10); F_PERCENT_RANK : PERCENT_RANK(C, 10); F_RANK_PCT : RANK_PCT(C, 10); F_MEDIAN : MEDIAN(C, 9); F_QUANTILE : QUANTILE(C, 20, 0.25);",
    "fn_expanding": "F_BARSCOUNT : BARSCOUNT(REF(C, 5)); F_CUMSUM : CUMSUM(V); F_CUMMAX : CUMMAX(H); F_CUMMIN : CUMMIN(L); F_TOTAL : TOTALBARSCOUNT; F_CURRENT : CURRBARSCOUNT; F_LASTBAR : ISLASTBAR; F_CONST : CONST(C);",
    "fn_cross_section": "R := ROCP(C, 5); F_RANK : CS_RANK(R); F_ZSCORE : CS_ZSCORE(R); F_SCALE : CS_SCALE(R); F_DEMEAN : CS_DEMEAN(R); F_POWER : CS_SIGNED_POWER(R, 0.5);",
    "formula_loops": "S := 0; FOR I = 1 TO 5 DO S := S + REF(C, I) * I; END; X := S; X /= 15; WEIGHTED : X; RAW : S;",
}

FORMULAS |= {
    "fn_aliases_lag": "F1 : LOG(C); F2 : CS_POWER(C / 100, 2); F3 : IFF(C > O, H, L); F4 : MATH_AVG(O, C); F5 : SHIFT(C, 2); F6 : REFX(C, 2); F7 : MTM(C, 3); F8 : MOMENTUM(C, 3); F9 : MINUS(C, 3); M3 := MA(C, 3); M9 := MA(C, 9); F10 : CROSSUP(M3, M9); F11 : CROSSOVER(M3, M9); F12 : GOLDEN_CROSS(M3, M9); F13 : BULLISH_CROSS(M3, M9); F14 : EM_CROSS(M3, M9); F15 : CROSSBELOW(M3, M9); F16 : DEAD_CROSS(M3, M9); F17 : BEARISH_CROSS(M3, M9); F18 : RELSTRENGTH(C, O, 5); F19 : RS_EXCESS_RETURN(C, O, 5); F20 : CUM(V); F21 : CONSECUTIVE_LIMIT(C > O);",
    "fn_aliases_window": "F1 : AVGPRICE_N(C, 5); F2 : TOTALVOL(V, 5); F3 : MAXPRICE(H, 5); F4 : DONCHIAN_UPPER(H, 5); F5 : MINPRICE(L, 5); F6 : MINMAX(L, 5); F7 : DONCHIAN_LOWER(L, 5); F8 : Z_SCORE(C, 20); F9 : BOLLMID(C, 20); F10 : BBANDS_MIDDLE(C, 20); F11 : BBANDS(C, 20, 2); F12 : BOLLINGER(C, 20, 2); F13 : BBANDS_LOWER(C, 20, 2); F14 : DONCHIAN_MID(H, L, 20); F15 : DONCHIAN_MIDDLE(H, L, 20); F16 : TENKAN_SEN(H, L, 9); F17 : ICHIMOKU_TENKAN(H, L, 9); F18 : KIJUN_SEN(H, L, 26); F19 : ICHIMOKU_KIJUN(H, L, 26); F20 : WR(H, L, C, 14); F21 : CHOPPINESS(H, L, C, 14); F22 : VORTEX(H, L, C, 14); F23 : CORR(H, L, 10); F24 : AVGDEV(C, 10); F25 : AROON(H, L, 14); F26 : AROON_DOWN(H, L, 14);",
    "fn_aliases_screens": "F1 : BREAKOUT_UP(C, H, 20); F2 : PRICE_BREAKOUT(C, H, 20); F3 : BREAKOUT_DOWN(C, L, 20); F4 : PRICE_BREAKDOWN(C, L, 20); F5 : VOLSURGE(V, 10, 1.2); F6 : VOLUME_EXPANSION(V, 10, 1.2); F7 : LINEARREG_SLOPE(C, 14); F8 : FORCAST(C, 14); F9 : FORECAST(C, 14); F10 : LINEAR_REG(C, 14);",
    "fn_bands_more": "F_ACC : ACCBANDS(H, L, C, 20); F_ACCM : ACCBANDS_MID(H, L, C, 20); F_ACCL : ACCBANDS_LOWER(H, L, C, 20); F_FR : FRACTAL(H, L, 2, 2); F_FRH : FRACTAL_HIGH(H, L, 3, 1); F_FRL : FRACTAL_LOW(H, L); F_PDM : PLUS_DM(H, L); F_MDM : MINUS_DM(H, L); F_CMOU : CMOU(C, 14); F_GAP : GAP_SIGNAL(O, C, 0.01); F_GAPA : GAP(O, C);",
    "fn_positions": "F_FH : FINDHIGH(H, 9, 4, 1); F_FL : FINDLOW(L, 9, 4, 1); F_BACK : BACKSET(C > 150, 3); F_SINCE : BARSSINCEN(C > 150, 2); F_STATUS : BARSTATUS; F_AT : REFDATE(C, 4); F_TYPE : PERIODTYPE; F_PR : PERCENTRANK(C, 10); F_SORT : SORT(C, 9, 1); F_SORTD : SORT(C, 9, 0); F_PCT : PERCENTILE(C, 11, 30); F_MMI : MINMAXINDEX(C, 10); F_BETA : BETA(C, O, 12);",
    "fn_flows": "F_RS : RS_RATIO(C, O, 5); F_TURN : TURNOVER(V, H); F_FLOW : MONEY_FLOW(H, L, C, V, 10); F_IND : CS_INDNEUTRALIZE(C, V); F_CAP : CAPITAL; F_IC : INDEXC; F_IO : INDEXO; F_IH : INDEXH; F_IL : INDEXL; F_IV : INDEXV; F_IA : INDEXA; F_BIG : BIGORDER; F_SMALL : SMALLORDER; F_SUPER : SUPERBIGORDER; F_MAIN : MAININFLOW; F_MAINP : MAININFLOWPCT; F_MF : MONEYFLOW; F_NET : NETINFLOW; F_ZL : EM_ZLCCV; F_DK : DKCOL; F_FIN : FINANCE(7); F_DYNA : DYNAINFO(3); F_BA : BLOCKAVG(1); F_BI : BLOCKINDEX(1);",
}
FORMULAS["fn_candles_one_bar"] = " ".join(f"F_{p[3:]} : {p}(O, H, L, C);" for p in candles.PATTERNS[:16])
FORMULAS["fn_candles_more_bars"] = " ".join(f"F_{p[3:]} : {p}(O, H, L, C);" for p in candles.PATTERNS[16:31])
FORMULAS["fn_candles_long_patterns"] = " ".join(f"F_{p[3:]} : {p}(O, H, L, C);" for p in candles.PATTERNS[31:])
_NAMES = tuple(alpha.FAMILIES)
FORMULAS["factors_alpha101"] = alpha.alpha101()
FORMULAS["factors_alpha158_shapes"] = alpha.alpha158((), (), True)
for _i, _part in enumerate((_NAMES[:8], _NAMES[8:15], _NAMES[15:23], _NAMES[23:])):
    FORMULAS[f"factors_alpha158_part{_i + 1}"] = alpha.alpha158(alpha.WINDOWS, _part, False)

#: Formula queries with recursive functions; checked against published golden values and plain Python in the tests.
RECURSIVE: dict[str, str] = {
    "fn_recursive_averages": "F_EMA : EMA(C, 12); F_SMA : SMA(C, 12, 1); F_RMA : RMA(C, 14); F_DMA : DMA(C, V / 100); F_DEMA : DEMA(C, 10); F_TEMA : TEMA(C, 10); F_TRIX : TRIX(C, 9); F_KAMA : KAMA(C, 10);",
    "fn_recursive_oscillators": "F_RSI : RSI(C, 14); F_MACD : MACD(C, 12, 26, 9); F_SIGNAL : MACD_SIGNAL(C, 12, 26, 9); F_HIST : MACD_HIST(C, 12, 26, 9); F_K : KDJ(H, L, C, 9, 3, 3); F_D : KDJ_D(H, L, C, 9, 3, 3); F_J : KDJ_J(H, L, C, 9, 3, 3);",
    "fn_recursive_trend": "F_ATR : ATR(H, L, C, 14); F_ADX : ADX(H, L, C, 14); F_PLUS : PLUS_DI(H, L, C, 14); F_MINUS : MINUS_DI(H, L, C, 14); F_SAR : SAR(H, L, 0.02, 0.2); F_NVI : NVI(C, V); F_PVI : PVI(C, V);",
    "fn_recursive_more": "F_NATR : NATR(H, L, C, 14); F_ADXR : ADXR(H, L, C, 14); F_ADOSC : ADOSC(H, L, C, V, 3, 10); F_EFI : EFI(C, V, 13); F_ZLEMA : ZLEMA(C, 12); F_MASS : MASS(H, L, 9, 25); F_TSI : TSI(C, 25, 13); F_STOCHRSI : STOCHRSI(C, 14, 14); F_T3 : T3(C, 5, 0.7); F_HO : HEIKIN_OPEN(O, H, L, C); F_HC : HEIKIN_CLOSE(O, H, L, C); F_SUPER : SUPERTREND(H, L, C, 10, 3); F_DIR : SUPERTREND_DIR(H, L, C, 10, 3); F_CMOW : CMO_WILDER(C, 14); F_ST : SUPERTREND_LINE(H, L, C, 10, 3); F_TB : TREND_BREAKOUT(H, L, C, V, 5, 20, 10, 10, 1.2); F_TS : TREND_SCREEN(H, L, C, V, 5, 20, 10, 10); F_BS : BREAKOUT_SCREEN(H, L, C, V, 5, 20, 10, 10);",
    "fn_recursive_aliases": "F_E1 : EXPMA(C, 12); F_E2 : EXPMEMA(C, 12); F_M1 : MACD_DIF(C, 12, 26, 9); F_M2 : MACD_DEA(C, 12, 26, 9); F_K : KDJ_K(H, L, C, 9, 3, 3); F_AD : ADOSC_OF_AD(AD(H, L, C, V), 3, 10); F_DIFF : DIFF(C, 12, 26); F_ERI : ERI(H, L, C, 13); F_ERIB : ERI_BULL(H, L, C, 13); F_ERIR : ERI_BEAR(H, L, C, 13); F_PVO : PVO(V, 12, 26); F_CVI : CVI(H, L, 10, 10); F_MASSI : MASSI(H, L, 9, 25); F_ALIGN : MA_ALIGN(C, 5, 10, 20); F_ALIGN2 : MA_ALIGNMENT(C, 5, 10, 20); F_ALIGN3 : TREND_ALIGN(C, 5, 10, 20);",
    "fn_recursive_movement": "F_KC : KC(H, L, C, 20, 10, 2); F_KCM : KC_MID(H, L, C, 20, 10); F_KCL : KC_LOWER(H, L, C, 20, 10, 2); F_DMI : DMI(H, L, C, 14); F_PDI : PDI(H, L, C, 14); F_MDI : MDI(H, L, C, 14); F_DX : DX(H, L, C, 14); F_KD : KD(H, L, C, 9, 3, 3); F_HA : HA(O, H, L, C); F_HAC : HA_CLOSE(O, H, L, C); F_HAS : HEIKIN_ASHI(O, H, L, C); F_HAO : HA_OPEN(O, H, L, C); F_HAH : HA_HIGH(O, H, L, C); F_HAL : HA_LOW(O, H, L, C); F_SMI : SMI(H, L, C); F_SMIS : SMI_SIGNAL(H, L, C); F_FILTER : FILTER(C > O, 5);",
    "formula_recursive_nested": "DIF := EMA(C, 12) - EMA(C, 26); DEA := EMA(DIF, 9); BAR : 2 * (DIF - DEA); GOLD : CROSS(DIF, DEA); SMOOTH : MA(RSI(C, 6), 5);",
}


#: Decimals of the results where six are not right for the size of the values.
DIGITS = {"fn_volume": 3, "fn_flows": 3}
#: Queries over bars with host columns.
HOSTED = {"fn_flows"}


#: Host columns that the queries of host series put beside the bars, as SQL of the bars.
HOST_COLUMNS = {
    "index_open": "open * 2", "index_high": "high * 2", "index_low": "low * 2", "index_close": "close * 2", "index_volume": "volume * 3", "index_amount": "volume * close", "capital": "1000", "bigorder": "volume / 4",
    "smallorder": "volume / 8", "superbigorder": "volume / 16", "maininflow": "volume - 2", "maininflowpct": "volume / 100", "moneyflow": "volume * 5", "netinflow": "volume - 7", "em_zlccv": "close + 1",
    "buyvol": "volume * 2", "sellvol": "volume", "finance_7": "volume + 7", "dynainfo_3": "open", "blockavg_1": "close * 3", "blockindex_1": "close * 4",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formula(FORMULAS["formula_moving_average_cross"])(spark, sf_dir)


def _formula(source: str, digits: int = 6, host: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = event_bars(spark, sf_dir)
        if host:
            bars = bars.selectExpr("*", *[f"{text} AS {name}" for name, text in HOST_COLUMNS.items()])
        return eval_formula(bars, source, digits=digits).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return run


def _formula_sql(source: str, digits: int = 6, host: bool = False) -> str:
    if not host:
        c = Compiler(dialect=DUCK).compile(source)
        return c.sql(EVENT_BARS_SQL, c.finish(digits=digits))
    c = Compiler({*MARKET.values(), *HOST_COLUMNS}, dialect=DUCK).compile(source)
    more = ", ".join(f"{text} AS {name}" for name, text in HOST_COLUMNS.items())
    return c.sql(f"SELECT *, {more} FROM ({EVENT_BARS_SQL})", c.finish(digits=digits))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _formula(source, DIGITS.get(name, 6), name in HOSTED) for name, source in (FORMULAS | RECURSIVE).items()}
    return out | studies.queries()


def oracle_sql() -> dict[str, str]:
    return {name: _formula_sql(source, DIGITS.get(name, 6), name in HOSTED) for name, source in FORMULAS.items()} | recursions.oracle_sql() | studies.oracle_sql()
