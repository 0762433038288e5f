"""Thresholds, weights and word lists. Lists are data: pass your own, or read them from files (see sources)."""

from __future__ import annotations

#: Origin of the coordinate grid in degrees and decimetres for a degree.
MIN_LON, MIN_LAT, MAX_LON, MAX_LAT = 4.4, 53.8, 35.0, 71.5
LON_SCALE, LAT_SCALE = 557999.790, 1114122.402
#: Metres of a nautical mile, of which a degree has 60.
MILE = 1853.1596

ROAD_METRES = 10_000
LOCAL_METRES = 20_000
UNIQUE_HITS, UNIQUE_METRES, UNIQUE_SURE = 30, 31_622, 1_000
ADMIN_SKIP_METRES, ADMIN_SKIP_IDS = 3_000, 4
DEDUPE_METRES = 1_000
MAX_WORDS, MAX_GAP = 3, 5
TOP_K = 20

#: How much each strategy counts.
ROAD_WEIGHT, CROSSING_WEIGHT, ADMIN_WEIGHT, LOCAL_WEIGHT, UNIQUE_WEIGHT, FALLBACK_WEIGHT = 1.0, 0.8, 0.95, 0.75, 0.8, 0.5
FALLBACK_RANK = {105: 1.0, 110: 0.9, 100: 0.6, 115: 0.8}
#: Quality by real-world type; anything else has 0.5.
TYPE_QUALITY = {100: 0.8, 105: 1.0, 110: 0.85, 115: 0.7, 400: 0.85, 401: 0.8, 300: 0.9}

#: Words by which a text announces a national or county road.
ROAD_WORDS = ("rv", "väg", "vägen", "riksväg", "riksvägen", "länsväg", "länsvägen")
#: Words that mean little alone.
VAGUE_WORDS = (
    "ny", "nya", "nytt", "gammal", "gamla", "gammalt",
    "västra", "östra", "norra", "södra",
    "väster", "öster", "norr", "söder",
    "inre", "yttre",
    "lilla", "stora",
    "nästa", "förre",
    "vita", "gröna", "röda", "blåa", "svarta",
    "pappa", "mamma", "son", "dotter",
    "bil", "bo", "bron", "bruk", "både", "by",
    "center", "centrala", "centrum", "city",
    "dahl", "daglig",
    "gård", "göta",
    "hamn", "halv", "hitta", "hos", "hus", "höjd",
    "kl", "km", "kommun", "kyrka",
    "län",
    "män",
    "nära",
    "plats", "platsen", "pris",
    "region", "regionens", "runt", "rör",
    "sankt", "s:t", "ser", "slott", "spår", "stad", "staden", "station", "svea", "sverige", "såg",
    "tf", "tid", "tillfällig", "torg", "torget",
    "vi", "via", "väg", "vägen",
    "år", "ö",
)
#: Words left out of a text before phrases are made. A starter list.
STOP_WORDS = ("och", "i", "på", "vid", "en", "ett", "det", "som", "av", "till", "för", "med", "the", "and", "of")
#: Words that look like a definite form and are none.
NO_DEFINITE = ("året", "åren")
#: Names of municipalities that end in s by themselves, so a stripped s comes back.
S_STEMS = (
    "alingsås", "bengtsfors", "bollnäs", "degerfors", "grums", "hagfors", "hofors", "hällefors", "höganäs", "kramfors", "munkfors",
    "mönsterås", "robertsfors", "sotenäs", "storfors", "strängnäs", "torsås", "tranås", "vännäs", "borås", "västerås",
)
ADMIN_SUFFIXES = ("s län", " län", "s kommun", " kommun")
#: Last parts of name keys that tell a foreign language.
FOREIGN = ("de", "en", "es", "fr", "fi", "ru", "pl", "it", "nl", "da", "no")
#: Ids that are not to be used, by table, for the map of Sweden; those that lie beyond its borders.
SKIP_RELATIONS = (2545969, 3189514, 5518156, 5756777, 5794315, 5794316)
SKIP_WAYS = (
    1648176, 1648475, 1651992, 2954124, 4605570, 8150233, 9702586, 23275365, 23444254, 23444292, 23444785, 23538748, 24040916, 24731206, 24731243,
    24786276, 24838509, 25380767, 25459932, 25953242, 26205243, 27565380, 27872415, 27872417, 27872418, 29054792, 29054793, 30784964, 30887520,
    34419027, 34419029, 37627542, 38227481, 38564589, 38564590, 42798132, 44141405, 44298775, 45329454, 45876899, 46931166, 48386475, 51381476,
    51385960, 53184762, 59065373, 59065380, 59065382, 59065388, 60928268, 61380105, 62080181, 64173539, 67171996, 69358305, 73854172, 80360747,
    116831322, 121821747, 127023670, 138001545, 138003259, 146294832, 180751968, 180987048, 194028774, 211946632, 216938864, 218214593, 225436893,
    229700851, 257700608, 258575332, 258575333, 258575334, 298780382, 298884852, 308918468, 308918469, 315471029, 321318578, 324044848, 324093398,
    324093732, 324201518, 324271180, 324492881, 324492887, 326365472, 345614344, 345614345, 347763180, 347763181, 347763182, 347763184, 347763185,
    347763186, 347763188, 366707779, 375573546, 375573548, 375671059, 375671060, 375671285, 375671286, 375671287, 383462866, 394305929, 394305930,
    399732015, 402989392, 413609159, 417220648, 417220650,
)
SKIP_ADMIN = (
    38091, 50046, 52822, 54224, 404589, 406060, 406106, 406567, 406621, 407717, 408105, 412436, 1650407, 1724359, 1724456, 2000320, 2375170, 2375171,
    2526815, 2541341, 2587236, 2978650, 4222805,
)
