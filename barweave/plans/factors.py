"""Factor libraries as formulas: number, minimum bars, formula.

The two alpha sets are published formula collections; their cross-section is taken along time per symbol:
rk(x) is the rank among the symbol's last 252 rows, industry neutralisation is the identity, scale divides by the
running sum of absolute values. ``cross=True`` ranks across symbols at each time instead. Windows inside a
formula must be full; a factor is NULL before its minimum bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import series

_S = "((lag(c, 20) - lag(c, 10)) / 10 - (lag(c, 10) - c) / 10)"
_CLV = "(((c - l) - (h - c)) / (h - l))"

ALPHA101 = f"""
001|25|rk(argmax(spow(std(ret, 20) if ret < 0 else c, 2), 5)) - 0.5
002|9|-1 * corr(rk(delta(log(v), 2)), rk((c - o) / o), 6)
003|10|-1 * corr(rk(o), rk(v), 10)
004|9|-1 * tsr(rk(l), 9)
005|10|rk(o - sum(vwap, 10) / 10) * (-1 * abs(rk(c - vwap)))
006|10|-1 * corr(o, v, 10)
007|67|-1 * tsr(abs(delta(c, 7)), 60) * sign(delta(c, 7)) if adv20 < v else -1
008|16|-1 * rk(sum(o, 5) * sum(ret, 5) - lag(sum(o, 5) * sum(ret, 5), 10))
009|6|delta(c) if tsmin(delta(c), 5) > 0 or tsmax(delta(c), 5) < 0 else -1 * delta(c)
010|6|rk(delta(c) if tsmin(delta(c), 4) > 0 or tsmax(delta(c), 4) < 0 else -1 * delta(c))
011|4|(rk(tsmax(vwap - c, 3)) + rk(tsmin(vwap - c, 3))) * rk(delta(v, 3))
012|2|sign(delta(v)) * (-1 * delta(c))
013|257|-1 * rk(cov(rk(c), rk(v), 5))
014|256|-1 * rk(delta(ret, 3)) * corr(o, v, 10)
015|259|-1 * sum(rk(corr(rk(h), rk(v), 3)), 3)
016|257|-1 * rk(cov(rk(h), rk(v), 5))
017|275|-1 * rk(tsr(c, 10)) * rk(delta(delta(c))) * rk(tsr(v / adv20, 5))
018|262|-1 * rk(std(abs(c - o), 5) + (c - o) + corr(c, o, 10))
019|503|-1 * sign((c - lag(c, 7)) + delta(c, 7)) * (1 + rk(1 + sum(ret, 250)))
020|253|-1 * rk(o - lag(h, 1)) * rk(o - lag(c, 1)) * rk(o - lag(l, 1))
021|20|-1 if mean(c, 8) + std(c, 8) < mean(c, 2) else (1 if mean(c, 2) < mean(c, 8) - std(c, 8) else (1 if v / adv20 >= 1 else -1))
022|20|-1 * delta(corr(h, v, 5), 5) * rk(std(c, 20))
023|20|-1 * delta(h, 2) if mean(h, 20) < h else 0
024|200|-1 * (c - tsmin(c, 100)) if delta(mean(c, 100), 100) / lag(c, 100) <= 0.05 else -1 * delta(c, 3)
025|20|rk(-1 * ret * adv20 * vwap * (h - c))
026|12|-1 * tsmax(corr(tsr(v, 5), tsr(h, 5), 5), 3)
027|8|-1 if rk(sum(corr(rk(v), rk(vwap), 6), 2) / 2) > 0.5 else 1
028|24|scale(corr(adv20, l, 5) + (h + l) / 2 - c)
029|12|tsmin(rk(rk(scale(log(tsmin(rk(rk(-1 * rk(delta(c, 5)))), 2))))), 5) + tsr(lag(-1 * ret, 6), 5)
030|20|(1 - rk(sign(delta(c)) + sign(lag(delta(c), 1)) + sign(lag(delta(c), 2)))) * sum(v, 5) / sum(v, 20)
031|31|rk(rk(rk(dlin(-1 * rk(rk(delta(c, 10))), 10)))) + rk(-1 * delta(c, 3)) + sign(scale(corr(adv20, l, 12)))
032|235|scale(mean(c, 7) - c) + 20 * scale(corr(vwap, lag(c, 5), 230))
033|1|rk(o / c - 1)
034|6|rk((1 - rk(std(ret, 2) / std(ret, 5))) + (1 - rk(delta(c))))
035|33|tsr(v, 32) * (1 - tsr(c + h - l, 16)) * (1 - tsr(ret, 32))
036|200|2.21 * rk(corr(c - o, lag(v, 1), 15)) + 0.7 * rk(o - c) + 0.73 * rk(tsr(lag(-1 * ret, 6), 5)) + rk(abs(corr(vwap, adv20, 6))) + 0.6 * rk((sum(c, 200) / 200 - o) * (c - o))
037|202|rk(corr(lag(o - c, 1), c, 200)) + rk(o - c)
038|10|-1 * rk(tsr(c, 10)) * rk(c / o)
039|251|-1 * rk(delta(c, 7) * (1 - rk(dlin(v / adv20, 9)))) * (1 + rk(sum(ret, 250)))
040|10|-1 * rk(std(h, 10)) * corr(h, v, 10)
041|1|sqrt(h * l) - vwap
042|1|rk(vwap - c) / rk(vwap + c)
043|27|tsr(v / adv20, 20) * tsr(-1 * delta(c, 7), 8)
044|5|-1 * corr(h, rk(v), 5)
045|25|-1 * rk(sum(lag(c, 5), 20) / 20) * corr(c, v, 2) * rk(corr(sum(c, 5), sum(c, 20), 2))
046|21|-1 if {_S} > 0.25 else (1 if {_S} < 0 else -1 * delta(c))
047|253|rk(1 / c) * v / adv20 * (h * rk(h - c) / (sum(h, 5) / 5)) - rk(vwap - lag(vwap, 5))
048|252|corr(delta(c), delta(lag(c, 1)), 250) * delta(c) / c / sum((delta(c) / lag(c, 1)) ** 2, 250)
049|21|1 if {_S} < -0.1 else -1 * delta(c)
050|261|-1 * tsmax(rk(corr(rk(v), rk(vwap), 5)), 5)
051|21|1 if {_S} < -0.05 else -1 * delta(c)
052|245|(lag(tsmin(l, 5), 5) - tsmin(l, 5)) * rk((sum(ret, 240) - sum(ret, 20)) / 220) * tsr(v, 5)
053|10|-1 * delta(((c - l) - (h - c)) / (c - l), 9)
054|1|-1 * (l - c) * o ** 5 / ((l - h) * c ** 5)
055|264|-1 * corr(rk((c - tsmin(l, 12)) / (tsmax(h, 12) - tsmin(l, 12))), rk(v), 6)
056|256|-1 * rk(sum(ret, 10) / sum(sum(ret, 2), 3)) * rk(ret * c * v)
057|284|-1 * (c - vwap) / dlin(rk(argmax(c, 30)), 2)
058|15|-1 * tsr(dlin(corr(vwap, v, 3), 7), 5)
059|28|-1 * tsr(dlin(corr(vwap, v, 4), 16), 8)
060|262|-1 * (2 * scale(rk({_CLV} * v)) - scale(rk(argmax(c, 10))))
061|270|num(rk(vwap - tsmin(vwap, 16)) < rk(corr(vwap, adv180, 18)))
062|52|-1 * num(rk(corr(vwap, sum(adv20, 22), 10)) < rk(num(rk(o) + rk(o) < rk((h + l) / 2) + rk(h))))
063|283|-1 * (rk(dlin(delta(c, 2), 8)) - rk(dlin(corr(vwap * 0.318108 + o * 0.681892, sum(adv180, 37), 13), 12)))
064|148|-1 * num(rk(corr(sum(o * 0.178404 + l * 0.821596, 13), sum(adv120, 13), 17)) < rk(delta((h + l) / 2 * 0.178404 + vwap * 0.821596, 4)))
065|73|-1 * num(rk(corr(o * 0.00817205 + vwap * 0.99182795, sum(adv60, 9), 6)) < rk(o - tsmin(o, 14)))
066|17|-1 * (rk(dlin(delta(vwap, 4), 7)) + tsr(dlin((l - vwap) / (o - (h + l) / 2), 11), 7))
067|260|-1 * pow(rk(h - tsmin(h, 2)), rk(corr(vwap, adv20, 6)))
068|38|-1 * num(tsr(corr(rk(h), rk(adv15), 9), 14) < rk(delta(c * 0.518371 + l * 0.481629, 1)))
069|260|-1 * pow(rk(tsmax(delta(vwap, 2), 4)), tsr(corr(c * 0.490655 + vwap * 0.509345, adv20, 4), 9))
070|286|-1 * pow(rk(delta(vwap, 1)), tsr(corr(c, adv50, 17), 17))
071|213|max(tsr(dlin(corr(tsr(c, 3), tsr(adv180, 12), 18), 4), 16), tsr(dlin(rk(l + o - (vwap + vwap)) ** 2, 16), 4))
072|58|rk(dlin(corr((h + l) / 2, adv40, 9), 10)) / rk(dlin(corr(tsr(vwap, 4), tsr(v, 19), 7), 3))
073|22|-1 * max(rk(dlin(delta(vwap, 5), 3)), tsr(dlin(-1 * delta(o * 0.147155 + l * 0.852845, 2) / (o * 0.147155 + l * 0.852845), 3), 17))
074|80|-1 * num(rk(corr(c, sum(adv30, 37), 15)) < rk(corr(rk(h * 0.0261661 + vwap * 0.9738339), rk(v), 11)))
075|62|num(rk(corr(vwap, v, 4)) < rk(corr(rk(l), rk(adv50), 12)))
076|303|-1 * max(rk(dlin(delta(vwap, 1), 11)), tsr(dlin(tsr(corr(l, adv81, 8), 19), 17), 19))
077|45|min(rk(dlin((h + l) / 2 - vwap, 20)), rk(dlin(corr((h + l) / 2, adv40, 3), 6)))
078|65|pow(rk(corr(sum(l * 0.352233 + vwap * 0.647767, 20), sum(adv40, 20), 7)), rk(corr(rk(vwap), rk(v), 6)))
079|275|-1 * num(rk(delta(c * 0.60733 + o * 0.39267, 1)) < rk(corr(tsr(vwap, 3), tsr(adv150, 9), 14)))
080|262|-1 * pow(rk(sign(delta(o * 0.868128 + h * 0.131872, 4))), tsr(corr(h, adv10, 5), 5))
081|80|-1 * num(rk(log(prod(rk(corr(vwap, sum(adv10, 50), 8)) ** 4, 15))) < rk(corr(rk(vwap), rk(v), 5)))
082|289|-1 * min(rk(dlin(delta(o, 1), 14)), tsr(dlin(corr(v, o, 17), 6), 13))
083|7|rk(lag((h - l) / mean(c, 5), 2)) * rk(rk(v)) / ((h - l) / mean(c, 5) / (vwap - c))
084|34|spow(tsr(vwap - tsmax(vwap, 15), 20), delta(c, 5))
085|39|pow(rk(corr(h * 0.876703 + c * 0.123297, adv30, 10)), rk(corr(tsr((h + l) / 2, 4), tsr(v, 10), 7)))
086|58|-1 * num(tsr(corr(c, sum(adv20, 15), 6), 20) < rk(c - vwap))
087|285|-1 * max(rk(dlin(delta(c * 0.369701 + vwap * 0.630299, 1), 2)), tsr(dlin(abs(corr(adv81, c, 13)), 4), 14))
088|95|min(rk(dlin(rk(o) + rk(l) - (rk(h) + rk(c)), 8)), tsr(dlin(corr(tsr(c, 8), tsr(adv60, 21), 8), 7), 3))
089|28|tsr(dlin(corr(l, adv10, 6), 5), 3) - tsr(dlin(delta(vwap, 3), 10), 15)
090|260|-1 * pow(rk(c - tsmax(c, 4)), tsr(corr(adv40, l, 5), 2))
091|284|-1 * (tsr(dlin(dlin(corr(c, v, 9), 16), 3), 4) - rk(dlin(corr(vwap, adv30, 4), 2)))
092|50|min(tsr(dlin(num((h + l) / 2 + c < l + o), 15), 19), tsr(dlin(corr(rk(l), rk(adv30), 8), 7), 7))
093|300|tsr(dlin(corr(vwap, adv81, 17), 19), 7) / rk(dlin(delta(c * 0.524434 + vwap * 0.475566, 2), 16))
094|82|-1 * pow(rk(vwap - tsmin(vwap, 12)), tsr(corr(tsr(vwap, 20), tsr(adv60, 4), 18), 3))
095|81|num(rk(o - tsmin(o, 12)) < tsr(rk(corr(sum((h + l) / 2, 19), sum(adv40, 19), 13)) ** 5, 12))
096|103|-1 * max(tsr(dlin(corr(rk(vwap), rk(v), 4), 4), 8), tsr(dlin(argmax(corr(tsr(c, 7), tsr(adv60, 4), 4), 13), 14), 13))
097|310|-1 * (rk(dlin(delta(l * 0.721001 + vwap * 0.278999, 3), 20)) - tsr(dlin(tsr(corr(tsr(l, 7), tsr(adv60, 17), 4), 18), 15), 6))
098|56|rk(dlin(corr(vwap, sum(adv5, 26), 5), 7)) - rk(dlin(tsr(argmin(corr(rk(o), rk(adv15), 21), 9), 7), 8))
099|87|-1 * num(rk(corr(sum((h + l) / 2, 20), sum(adv60, 20), 9)) < rk(corr(l, v, 6)))
100|282|-1 * ((1.5 * scale(rk({_CLV} * v)) - scale(corr(c, rk(adv20), 5) - rk(argmin(c, 30)))) * (v / adv20))
101|1|(c - o) / (h - l + 0.001)
"""

_UPV = "(v if delta(c) > 0 else (-1 * v if delta(c) < 0 else 0))"
_A3 = "(0 if delta(c) == 0 else c - (min(l, lag(c, 1)) if delta(c) > 0 else max(h, lag(c, 1))))"
_HL = "max(abs(delta(h)), abs(delta(l)))"
_UPM, _DNM = f"({_HL} if delta(h + l) > 0 else 0)", f"({_HL} if delta(h + l) < 0 else 0)"
_RSV = lambda n: f"((c - tsmin(l, {n})) / (tsmax(h, {n}) - tsmin(l, {n})) * 100)"
_TOP = lambda n: f"((tsmax(h, {n}) - c) / (tsmax(h, {n}) - tsmin(l, {n})) * 100)"
_RSI = lambda n: f"(smooth(max(delta(c), 0), {n}, 1) / smooth(abs(delta(c)), {n}, 1) * 100)"
_RSIW = lambda n: f"(100 if wilder(down(c), {n}) == 0 else 100 - 100 / (1 + wilder(up(c), {n}) / wilder(down(c), {n})))"
_MACD = lambda x: f"(smooth({x}, 13, 2) - smooth({x}, 27, 2))"
_T3 = "smooth(smooth(smooth(log(c), 13, 2), 13, 2), 13, 2)"
_HD, _LD = "delta(h)", "(-1 * delta(l))"
_TR = "max(max(h - l, abs(lag(c, 1) - h)), abs(lag(c, 1) - l))"
_DI = lambda a, b: f"(sum({a} if {a} > 0 and {a} > {b} else 0, 14) * 100 / sum({_TR}, 14))"
_DX = f"(abs({_DI(_LD, _HD)} - {_DI(_HD, _LD)}) / ({_DI(_LD, _HD)} + {_DI(_HD, _LD)}) * 100)"
_A172 = f"mean({_DX}, 6)"
_SWING_BASE = "(abs(h - lag(c, 1)) + abs(l - lag(c, 1)) / 2 + abs(lag(c, 1) - lag(o, 1)) / 4 if abs(h - lag(c, 1)) > abs(l - lag(c, 1)) and abs(h - lag(c, 1)) > abs(h - lag(l, 1)) else (abs(l - lag(c, 1)) + abs(h - lag(c, 1)) / 2 + abs(lag(c, 1) - lag(o, 1)) / 4 if abs(l - lag(c, 1)) > abs(h - lag(l, 1)) and abs(l - lag(c, 1)) > abs(h - lag(c, 1)) else abs(h - lag(l, 1)) + abs(lag(c, 1) - lag(o, 1)) / 4))"
_SWING = f"nz(16 * (delta(c) + (c - o) / 2 + lag(c, 1) - lag(o, 1)) / {_SWING_BASE}, 0)"
_FUSE = lambda n, w: f"(c - sum(min(l, lag(c, 1)), {n})) / sum(max(h, lag(c, 1)) - min(l, lag(c, 1)), {n}) * {w}"
_B = "(o * 0.15 + l * 0.85)"

ALPHA191 = f"""
001|258|-1 * corr(rk(delta(log(v))), rk((c - o) / o), 6)
002|2|-1 * delta({_CLV})
003|7|sum({_A3}, 6)
004|20|-1 if mean(c, 8) + std(c, 8) < mean(c, 2) else (1 if mean(c, 2) < mean(c, 8) - std(c, 8) else (1 if v / adv20 >= 1 else -1))
005|12|-1 * tsmax(corr(tsr(v, 5), tsr(h, 5), 5), 3)
006|257|rk(sign(delta(o * 0.85 + h * 0.15, 4)))
007|67|-1 * tsr(abs(delta(c, 7)), 60) * sign(delta(c, 7)) if adv20 < v else -1
008|267|-1 * rk(sum(o, 5) * sum(ret, 5) - lag(sum(o, 5) * sum(ret, 5), 10))
009|6|delta(c) if tsmin(delta(c), 5) > 0 or tsmax(delta(c), 5) < 0 else -1 * delta(c)
010|257|rk(delta(c) if tsmin(delta(c), 4) > 0 or tsmax(delta(c), 4) < 0 else -1 * delta(c))
011|6|sum({_CLV} * v, 6)
012|2|sign(delta(v)) * (-1 * delta(c))
013|257|-1 * rk(cov(rk(c), rk(v), 5))
014|266|-1 * rk(delta(ret, 3)) * corr(o, v, 10)
015|261|-1 * sum(rk(corr(rk(h), rk(v), 3)), 3)
016|257|-1 * rk(cov(rk(h), rk(v), 5))
017|266|-1 * rk(tsr(c, 10)) * rk(delta(delta(c))) * rk(tsr(v / adv20, 5))
018|262|-1 * rk(std(abs(c - o), 5) + (c - o) + corr(c, o, 10))
019|510|-1 * sign(c - lag(c, 7) + delta(c, 7)) * (1 + rk(1 + sum(ret, 250)))
020|253|-1 * rk(o - lag(h, 1)) * rk(o - lag(c, 1)) * rk(o - lag(l, 1))
021|20|-1 if mean(c, 8) + std(c, 8) < mean(c, 2) else (1 if mean(c, 2) < mean(c, 8) - std(c, 8) else (1 if v / adv20 >= 1 else -1))
022|21|smooth((c - mean(c, 6)) / mean(c, 6) - lag((c - mean(c, 6)) / mean(c, 6), 3), 12, 1)
023|40|nz(100 * smooth(gate(21, std(c, 20) if delta(c) > 0 else 0), 20, 1) / (smooth(gate(21, std(c, 20) if delta(c) > 0 else 0), 20, 1) + smooth(gate(21, 0 if delta(c) > 0 else std(c, 20)), 20, 1)), 50)
024|10|smooth(c - lag(c, 5), 5, 1)
025|518|-1 * rk(delta(c, 7)) * (1 - rk(dlin(v / adv20, 9))) * (1 + rk(sum(ret, 250)))
026|12|-1 * tsmax(corr(tsr(v, 5), tsr(h, 5), 5), 3)
027|262|-1 if rk(sum(corr(rk(v), rk(vwap), 6), 2)) < 0.5 else 1
028|25|scale(corr(adv20, l, 5) + (h + l) / 2 - c)
029|270|min(rk(c), 5) + nz(tsr(lag(-1 * ret, 6), 5), 0)
030|21|sum(sign(delta(c)) * v, 20) / 20
031|276|rk(dlin(rk(rk(delta(c, 10))), 10)) - rk(delta(c, 3)) + sign(corr(adv20, l, 12))
032|237|scale(mean(c, 7) - c) + 20 * scale(corr(vwap, lag(c, 5), 230))
033|253|rk(-1 * (1 - o / c))
034|259|rk((1 - rk(std(ret, 2) / std(ret, 5))) + (1 - rk(delta(c))))
035|33|tsr(v, 32) * (1 - tsr(c + h - l, 16)) * (1 - tsr(ret, 32))
036|262|rk(sum(corr(rk(v), rk(vwap), 6), 2))
037|267|-1 * rk(sum(o, 5) * sum(ret, 5) - lag(sum(o, 5) * sum(ret, 5), 10))
038|22|-1 * delta(h, 2) if sum(h, 20) / 20 < h else 0
039|283|-1 * (rk(dlin(delta(c, 2), 8)) - rk(dlin(rk(corr(vwap * 0.3 + o * 0.7, sum(emean(v, 180), 37), 14)), 12)))
040|262|-1 * rk(std(h, 10)) * corr(h, v, 10)
041|1|sqrt(h * l) - vwap
042|253|rk(vwap - c) / rk(vwap + c)
043|27|tsr(v / adv20, 20) * tsr(-1 * delta(c, 7), 8)
044|257|-1 * corr(h, rk(v), 5)
045|277|-1 * rk(sum(lag(c, 5), 20) / 20) * corr(c, v, 2) * rk(corr(sum(c, 5), sum(c, 20), 2))
046|21|-1 if (lag(c, 10) - lag(c, 20)) / 10 - (c - lag(c, 10)) / 10 > 0.25 else (1 if (lag(c, 10) - lag(c, 20)) / 10 - (c - lag(c, 10)) / 10 < 0 else -1 * delta(c))
047|15|smooth({_TOP(6)}, 9, 1)
048|273|-1 * rk(sign(delta(c)) + sign(lag(delta(c), 1)) + sign(lag(delta(c), 2))) * sum(v, 5) / sum(v, 20)
049|13|nz(sum({_DNM}, 12) / (sum({_DNM}, 12) + sum({_UPM}, 12)), gate(13, 0.5))
050|13|2 * nz(sum({_DNM}, 12) / (sum({_DNM}, 12) + sum({_UPM}, 12)), gate(13, 0.5)) - 1
051|13|1 - nz(sum({_DNM}, 12) / (sum({_DNM}, 12) + sum({_UPM}, 12)), gate(13, 0.5))
052|27|nz(100 * sum(max(0, h - lag(vwap, 1)), 26) / sum(max(0, lag(vwap, 1) - l), 26), gate(27, 100))
053|13|count(delta(c) > 0, 12) / 12 * 100
054|262|-1 * rk(std(abs(c - o), 5) + (c - o) + corr(c, o, 10))
055|21|sum({_SWING} * max(abs(h - lag(c, 1)), abs(l - lag(c, 1))), 20)
056|284|num(rk(o - tsmin(o, 12)) < rk(corr(sum((h + l) / 2, 19), sum(adv40, 19), 13)) ** 5)
057|12|smooth({_RSV(9)}, 3, 1)
058|21|count(delta(c) > 0, 20) / 20 * 100
059|21|sum({_A3}, 20)
060|20|sum({_CLV} * v, 20)
061|269|-1 * max(rk(dlin(delta(vwap), 12)), rk(dlin(rk(corr(l, adv80, 8)), 17)))
062|257|-1 * corr(h, rk(adv20), 5)
063|7|{_RSIW(6)}
064|283|-1 * max(rk(dlin(corr(rk(vwap), rk(v), 4), 4)), rk(dlin(argmax(corr(rk(c), rk(adv60), 4), 13), 14)))
065|6|mean(c, 6) / c
066|6|(c - mean(c, 6)) / mean(c, 6) * 100
067|25|{_RSIW(24)}
068|16|smooth(delta((h + l) / 2) * (h - l) / v, 15, 1)
069|21|nz((sum(max(h - o, delta(o)) if delta(o) > 0 else 0, 20) - sum(max(o - l, delta(o)) if delta(o) < 0 else 0, 20)) / max(sum(max(h - o, delta(o)) if delta(o) > 0 else 0, 20), sum(max(o - l, delta(o)) if delta(o) < 0 else 0, 20)), gate(21, 0))
070|6|std(c * v, 6)
071|24|(c - mean(c, 24)) / mean(c, 24) * 100
072|21|smooth({_TOP(6)}, 15, 1)
073|287|-1 * (tsr(dlin(dlin(corr(c, v, 10), 16), 4), 5) - rk(dlin(corr(vwap, adv30, 4), 3)))
074|279|rk(corr(sum(l * 0.35 + vwap * 0.65, 20), sum(adv40, 20), 7)) + rk(corr(rk(vwap), rk(v), 6))
075|51|count(c > o, 50) / 50
076|21|std(abs(ret) / v, 20) / mean(abs(ret) / v, 20)
077|295|min(rk(dlin((h + l) / 2 - vwap, 20)), rk(dlin(corr((h + l) / 2, adv40, 3), 6)))
078|24|(vwap - mean(vwap, 12)) / (0.015 * mean(abs(c - mean(vwap, 12)), 12))
079|13|{_RSIW(12)}
080|6|(v - lag(v, 5)) / lag(v, 5) * 100
081|21|smooth(v, 21, 2)
082|7|{_RSI(6)}
083|257|-1 * rk(cov(rk(h), rk(v), 5))
084|21|sum({_UPV}, 20)
085|27|tsr(v / adv20, 20) * tsr(-1 * delta(c, 7), 8)
086|21|-1 * delta(c, 5) if mean(c, 20) < c else delta(c, 5)
087|270|rk(dlin(delta(vwap, 4), 7)) + tsr(dlin((l * 0.9 + h * 0.1 - vwap) / (o - 0.5 * (h + l)), 11), 7)
088|21|(c - lag(c, 20)) / lag(c, 20) * 100
089|50|2 * ({_MACD("c")} - smooth({_MACD("c")}, 10, 2))
090|257|-1 * rk(corr(rk(vwap), rk(v), 5))
091|297|-1 * rk(c - tsmax(c, 5)) * rk(corr(adv40, l, 5))
092|283|-1 * max(rk(dlin(delta(c * 0.35 + vwap * 0.65, 2), 3)), tsr(dlin(abs(corr(adv180, c, 13)), 5), 15))
093|21|sum(0 if delta(o) >= 0 else max(o - l, delta(o)), 20)
094|31|sum({_UPV}, 30)
095|20|std(c * v, 20)
096|15|smooth(smooth({_RSV(9)}, 3, 1), 3, 1)
097|10|std(v, 10)
098|38|dlin(corr(vwap, sum(adv5, 26), 5), 7)
099|257|-1 * rk(cov(rk(c), rk(v), 5))
100|20|std(v, 20)
101|1|(c - o) / (h - l + 0.001)
102|7|smooth(max(delta(v), 0), 6, 1) / smooth(abs(delta(v)), 6, 1) * 100
103|20|lowday(l, 20)
104|262|-1 * delta(corr(h, v, 5), 5) * rk(std(c, 20))
105|262|-1 * corr(rk(o), rk(v), 10)
106|21|c - lag(c, 20)
107|253|-1 * rk(o - lag(h, 1)) * rk(o - lag(c, 1)) * rk(o - lag(l, 1))
108|278|-1 * pow(rk(h - tsmin(h, 2)), rk(corr(vwap, adv120, 6)))
109|20|smooth(h - l, 10, 2) / smooth(smooth(h - l, 10, 2), 10, 2)
110|21|sum(max(0, h - lag(c, 1)), 20) / sum(max(0, lag(c, 1) - l), 20) * 100
111|12|smooth(v * {_CLV}, 11, 2) - smooth(v * {_CLV}, 4, 2)
112|13|(sum(max(delta(c), 0), 12) - sum(max(-1 * delta(c), 0), 12)) / (sum(max(delta(c), 0), 12) + sum(max(-1 * delta(c), 0), 12)) * 100
113|277|-1 * rk(sum(lag(c, 5), 20) / 20) * corr(c, v, 2) * rk(corr(sum(c, 5), sum(c, 20), 2))
114|259|rk(lag((h - l) / mean(c, 5), 2)) * rk(rk(v)) / ((h - l) / mean(c, 5) / (vwap - c))
115|272|pow(rk(corr(h * 0.9 + c * 0.1, adv30, 10)), rk(corr(tsr((h + l) / 2, 4), tsr(v, 10), 7)))
116|20|linslope(c, 20)
117|33|tsr(v, 32) * (1 - tsr(c + h - l, 16)) * (1 - tsr(ret, 32))
118|20|sum(h - o, 20) / sum(o - l, 20) * 100
119|295|rk(dlin(corr(vwap, sum(adv5, 26), 5), 7)) - rk(dlin(tsr(tsmin(corr(rk(o), rk(adv15), 21), 9), 7), 8))
120|253|rk(vwap - c) / rk(vwap + c)
121|253|rk(vwap - c) / rk(vwap + c)
122|40|({_T3} - lag({_T3}, 1)) / lag({_T3}, 1)
123|292|rk(corr(sum((h + l) / 2, 20), sum(adv60, 20), 9))
124|284|(c - vwap) / dlin(rk(tsmax(c, 30)), 2)
125|370|rk(dlin(corr(vwap, adv80, 17), 20)) / rk(dlin(delta(c * 0.5 + vwap * 0.5, 3), 16))
126|1|(c + h + l) / 3
127|24|sqrt(mean((100 * (c - tsmax(c, 12)) / tsmax(c, 12)) ** 2, 12))
128|15|nz(100 - 100 / (1 + sum({_CLV} * v if delta(h + l) > 0 else 0, 14) / (abs(sum({_CLV} * v if delta(h + l) < 0 else 0, 14)) + 0.0000000001)), 50)
129|13|sum(max(-1 * delta(c), 0), 12)
130|310|rk(dlin(corr((h + l) / 2, adv40, 9), 10)) / rk(dlin(corr(rk(vwap), rk(v), 7), 3))
131|322|pow(rk(delta(vwap)), tsr(corr(c, adv50, 18), 18))
132|20|mean(c * v, 20)
133|20|(20 - highday(h, 20)) / 20 * 100 - (20 - lowday(l, 20)) / 20 * 100
134|13|(c - lag(c, 12)) / lag(c, 12) * v
135|42|smooth(lag(c / lag(c, 20), 1), 20, 1)
136|266|-1 * rk(delta(ret, 3)) * corr(o, v, 10)
137|2|{_SWING}
138|300|rk(dlin(corr(l, adv20, 7), 8)) - rk(dlin(delta(l * 0.7 + vwap * 0.3, 3), 10))
139|10|-1 * corr(o, v, 10)
140|350|min(rk(dlin(rk(o) + rk(l) - rk(h) - rk(c), 8)), tsr(dlin(corr(tsr(c, 8), tsr(adv60, 20), 8), 7), 3))
141|276|-1 * rk(corr(rk(h), rk(adv15), 9))
142|275|-1 * rk(tsr(c, 10)) * rk(delta(delta(c))) * rk(tsr(v / adv20, 5))
143|2|ret
144|21|nz(sum(abs(ret) / (c * v) if delta(c) < 0 else 0, 20) / count(delta(c) < 0, 20), gate(21, 0))
145|26|(mean(v, 9) - mean(v, 26)) / mean(v, 12) * 100
146|82|mean((ret - smooth(ret, 61, 2)) ** 2, 20)
147|24|linslope(mean(c, 12), 12)
148|330|rk(corr(o, sum(adv60, 9), 6)) - rk(o - tsmin(o, 14))
149|253|linslope(ret if ret < 0 else null, 252)
150|1|vwap * v
151|41|smooth(c - lag(c, 20), 20, 1)
152|60|smooth(mean(lag(smooth(lag(c / lag(c, 9), 1), 9, 1), 1), 12) - mean(lag(smooth(lag(c / lag(c, 9), 1), 9, 1), 1), 26), 9, 1)
153|24|(mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4
154|435|num(vwap - tsmin(vwap, 16) < corr(vwap, adv180, 18))
155|40|{_MACD("v")} - smooth({_MACD("v")}, 10, 2)
156|280|max(rk(dlin(delta(vwap, 5), 3)), rk(dlin(-1 * delta({_B}) / {_B}, 3)))
157|20|-1 * tsr(c, 5) + tsr(lag(-1 * ret, 6), 5)
158|15|h - l
159|25|({_FUSE(6, 288)} + {_FUSE(12, 144)} + {_FUSE(24, 1)}) * 100 / 504
160|40|smooth(std(c, 20) if delta(c) <= 0 else 0, 20, 1)
161|13|mean({_TR}, 12)
162|13|{_RSI(12)}
163|253|rk(-1 * ret * adv20 * vwap * (h - c))
164|27|smooth(((1 / delta(c) if delta(c) > 0 else 1) - tsmin(1 / delta(c) if delta(c) > 0 else 1, 12)) / (h - l) * 100, 13, 2)
165|48|abs(sum(c, 48) - 48 * mean(c, 48)) / std(c, 48)
166|21|-1 * {20 * 19**1.5} * (sum(ret ** 3, 20) - 3 * mean(ret, 20) * sum(ret ** 2, 20) + 40 * mean(ret, 20) ** 3) / ({19 * 18} * pow(sum(ret ** 2, 20) - 20 * mean(ret, 20) ** 2, 1.5))
167|13|sum(max(delta(c), 0), 12)
168|20|-1 * v / adv20
169|50|smooth(mean(lag(smooth(delta(c), 9, 1), 1), 12) - mean(lag(smooth(delta(c), 9, 1), 1), 26), 10, 1)
170|253|rk(1 / c) * v / adv20 * (h * rk(h - c) / mean(h, 5) - vwap)
171|1|-1 * (l - c) * o ** 5 / ((c - h) * c ** 5)
172|21|{_A172}
173|40|3 * smooth(c, 13, 2) - 2 * smooth(smooth(c, 13, 2), 13, 2) + {_T3}
174|40|smooth(std(c, 20) if delta(c) > 0 else 0, 20, 1)
175|7|mean({_TR}, 6)
176|270|corr(rk((c - tsmin(l, 12)) / (tsmax(h, 12) - tsmin(l, 12))), rk(v), 6)
177|20|(20 - highday(h, 20)) / 20 * 100
178|2|ret * v
179|315|rk(corr(vwap, v, 4)) * rk(corr(rk(l), rk(adv50), 12))
180|68|-1 * tsr(abs(delta(c, 7)), 60) * sign(delta(c, 7)) if adv20 < v else -1 * v
181|21|(sum(ret, 20) - 20 * mean(ret, 20)) * {19**-1.5} / sum(ret ** 2, 20)
182|20|count(c > o, 20) / 20
183|24|abs(sum(c, 24) - 24 * mean(c, 24)) / std(c, 24)
184|454|rk(corr(lag(o - c, 1), c, 200)) + rk(o - c)
185|253|rk(-1 * (1 - o / c) ** 2)
186|28|({_A172} + lag({_A172}, 6)) / 2
187|21|sum(0 if delta(o) <= 0 else max(h - o, delta(o)), 20)
188|11|(h - l - smooth(h - l, 11, 2)) / smooth(h - l, 11, 2)
189|12|mean(abs(c - mean(c, 6)), 6)
190|21|log(count(1 + ret > pow(1 + ret, {1 / 252}), 20) * sum(ret ** 2 if ret < 0 else 0, 20) / (count(ret < 0, 20) * sum(ret ** 2 if ret > 0 else 0, 20)))
191|25|corr(adv20, l, 5) + (h + l) / 2 - c
"""

_MKT = "mean(ret, 20)"
_MOM = lambda n: f"(c / lag(c, {n}) - 1)"
_BETA = lambda n: f"slope(ret, {_MKT}, {n})"
#: E[r m^2] centred, over the deviations' product.
_COSKEW = (
    f"(mean(ret * {_MKT} ** 2, 252) - 2 * mean({_MKT}, 252) * mean(ret * {_MKT}, 252) - mean(ret, 252) * mean({_MKT} ** 2, 252) + 2 * mean(ret, 252) * mean({_MKT}, 252) ** 2)"
    f" / (std(ret, 252) * var({_MKT}, 252))"
)
_DOWN = f"({_MKT} < 0)"
_COND = lambda x: f"esum({x} if {_DOWN} else 0, 252)"

JKP = f"""
52WHigh|252|c / tsmax(h, 252)
Beta60M|1282|{_BETA(1260)}
BetaDM|279|{_BETA(252)} + {" + ".join(f"slope(ret, lag({_MKT}, {k}), 252)" for k in range(1, 6))}
BetaDown|274|({_COND(f"ret * {_MKT}")} / {_COND("1")} - {_COND("ret")} * {_COND(_MKT)} / {_COND("1")} ** 2) / ({_COND(f"{_MKT} ** 2")} / {_COND("1")} - ({_COND(_MKT)} / {_COND("1")}) ** 2) if {_COND("1")} >= 3 else null
Coskew|274|{_COSKEW}
IVolCAPM|274|sqrt(max(var(ret, 252) - {_BETA(252)} ** 2 * var({_MKT}, 252), 0))
Mom12M|253|{_MOM(252)} - {_MOM(21)}
Mom1M|22|{_MOM(21)}
Mom36M|757|{_MOM(756)} - {_MOM(252)}
Mom6M|127|{_MOM(126)} - {_MOM(21)}
MomInt|169|{_MOM(168)} - {_MOM(21)}
MomOff|253|{_MOM(126)} - lag({_MOM(126)}, 126)
MomRevLT|757|{_MOM(756)}
PriceDelay|258|1 - corr(ret, lag(ret, 1), 252) ** 2 / corr(ret, lag(ret, 5), 252) ** 2
RMax21|23|tsmax(ret, 21)
RMax5|7|tsmax(ret, 5)
RVol21|23|std(ret, 21)
Rev1M|22|-1 * {_MOM(21)}
Rev1W|6|-1 * {_MOM(5)}
RevIdio|43|-1 * (ret - {_BETA(21)} * {_MKT})
SeasTOM|23|(mean(ret, 5) if mod(t - 1, 21) <= 3 or mod(t - 1, 21) == 20 else 0)
SeasYr|505|(lag(ret, 252) + lag(ret, 504)) / 2
Skew|253|skew(ret, 252)
TVol|253|std(ret, 252)
VolTrend|126|mean(v, 21) / mean(v, 126)
"""

LIBRARIES = {"alpha101": ALPHA101, "alpha191": ALPHA191, "jkp": JKP}


def factors(library: str, names: list[str] | None = None) -> dict[str, str]:
    """Column name to formula, gated by the factor's minimum bars."""
    out = {}
    for line in LIBRARIES[library].strip().split("\n"):
        name, least, text = line.split("|")
        if names is None or name in names:
            out[f"{library}_{name.lower()}"] = text if least == "1" else f"gate({least}, {text})"
    return out


def min_bars(library: str) -> dict[str, int]:
    return {f"{library}_{x.split('|')[0].lower()}": int(x.split("|")[1]) for x in LIBRARIES[library].strip().split("\n")}


def compute(bars: DataFrame, library: str, names: list[str] | None = None, cross: bool = False) -> DataFrame:
    """Factor columns per bar. ``cross`` adds, per factor, its percent rank among the symbols of the same time."""
    wanted = factors(library, names)
    df = series.with_series(bars, wanted)
    if cross:
        at = W.partitionBy("ts")
        df = df.select("*", *[F.when(F.col(c).isNotNull(), F.percent_rank().over(at.orderBy(F.col(c).asc_nulls_first()))).alias(f"{c}_cross") for c in wanted])
    return df
