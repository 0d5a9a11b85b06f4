"""Fixed values that results must share with what users run today: word lists, keyword tables, marks."""

from __future__ import annotations

#: Words without meaning of their own in targeting statements.
STOPWORDS = (
    "and", "or", "in", "the", "of", "a", "an", "on", "at", "to", "with", "for", "from", "by", "near", "into", "around", "between", "as", "is", "are", "be", "this", "that",
    "these", "those", "its", "it", "no", "site", "area", "region", "location", "feature", "features", "terrain", "possible", "candidate", "small", "large", "long",
    "monitoring", "monitor", "survey", "sample",
)

#: Names of surface features that statements mention.
GEO_FEATURES = (
    "crater", "chasma", "chasmata", "vallis", "valles", "planitia", "planum", "terra", "fossa", "fossae", "tholus", "mons", "montes", "patera", "labyrinthus", "sulci",
    "rupes", "dorsa", "cavi", "scopulus", "colles", "mensa", "mensae", "fluctus",
)

#: Themes with their keywords; the first theme that matches is the primary one.
THEMES = {
    "Impact craters": (
        "crater", "craters", "impact", "ejecta", "rayed", "pedestal crater", "secondary crater", "central peak", "central uplift", "fresh crater", "fresh impact",
        "candidate impact", "candidate recent impact", "newly formed", "rayed crater", "crater rim", "crater wall", "crater floor",
    ),
    "Gullies & slopes": (
        "gully", "gullies", "slope", "slopes", "scarp", "scarps", "RSL", "recurring", "lineae", "slope streak", "slope monitoring", "slope feature", "pole-facing", "pole facing",
    ),
    "Mass wasting & landslides": ("landslide", "rockfall", "debris flow", "mass wasting", "slump", "avalanche", "rock avalanche"),
    "Polar / ice / frost": (
        "polar", "ice", "frost", "defrosting", "araneiform", "araneiforms", "spider", "geyser", "seasonal", "cryptic", "residual cap", "polar layered", "PLD", "polar deposit",
        "polar dune", "polar gypsum", "polar erg", "icy",
    ),
    "Glacial / periglacial": (
        "periglacial", "polygon", "polygons", "patterned ground", "lobate", "lobate debris", "debris apron", "concentric crater fill", "concentric", "viscous flow", "glacier",
        "glacial", "ice-rich", "ice-cemented", "thermokarst",
    ),
    "Aeolian (wind)": (
        "dune", "dunes", "ripple", "ripples", "yardang", "TAR", "transverse aeolian", "dust devil", "devil track", "barchan", "erg", "aeolian", "wind", "active dune", "dust",
    ),
    "Fluvial / channels": (
        "channel", "channels", "valley", "valleys", "vallis", "valles", "fluvial", "alluvial", "delta", "inverted channel", "outflow", "tributary", "fan delta", "alluvial fan",
        "drainage", "sinuous ridge",
    ),
    "Layers & stratigraphy": (
        "layered", "layer", "layers", "bedrock", "stratigraphy", "outcrop", "exposure", "exposures", "deposits", "deposit", "stratified", "layered deposits", "layered deposit",
    ),
    "Mineralogy / hydrated": (
        "clay", "clays", "sulfate", "sulfates", "olivine", "olivine-rich", "iron-rich", "mafic", "phyllosilicate", "phyllosilicates", "phyllosilicate-rich", "carbonate",
        "carbonates", "hydrated", "polyhydrated", "monohydrated", "gypsum", "hematite", "smectite", "nontronite", "jarosite", "pyroxene", "altered", "alteration",
        "spectral signature", "iron",
    ),
    "Light/dark-toned": (
        "light-toned", "light toned", "dark-toned", "dark toned", "toned material", "toned bedrock", "toned deposit", "toned outcrop", "albedo", "bright deposit",
        "bright material", "dark streak", "slope streak",
    ),
    "Volcanic": ("lava", "lava flow", "volcanic", "vent", "tholus", "patera", "caldera", "flow front", "fissure vent", "pyroclastic"),
    "Tectonic / structural": ("fault", "faulted", "graben", "grabens", "fracture", "fractured", "wrinkle ridge", "wrinkle", "horst", "tectonic", "thrust"),
    "Landing sites & rovers": (
        "landing site", "landing", "rover", "InSight", "Curiosity", "Perseverance", "MSL", "Phoenix", "ExoMars", "Spirit", "Opportunity", "Pathfinder", "Viking",
        "future landing", "candidate landing", "Beagle",
    ),
    "Calibration / engineering": (
        "calibration", "ADC", "ADC settings", "settings test", "test observation", "MOC image", "validation", "engineering", "stray light", "geometry", "test image", "ride-along",
    ),
}

#: What a decoder says of a corrupt source, in lower case.
CORRUPT_MARKS = ("opj_decode", "ireadblock", "read failed", "tile part length", "not recognized as being in a supported file format")

#: The states of a queue and of its jobs.
QUEUED, RUNNING, COMPLETED, FAILED, SKIPPED = "queued", "running", "completed", "failed", "skipped"
