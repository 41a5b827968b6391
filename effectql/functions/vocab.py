"""Vocabularies of the card domain. Names, bits and words are those of the data."""

# Kinds of cards and texts.
CATEGORIES = ("MONSTER", "SPELL", "TRAP")
OBJECT_TYPES = ("MONSTER", "SPELL", "TRAP", "SPELL_TRAP")
SUB_CATEGORIES = [
    "NORMAL",
    "EFFECT",
    "FUSION",
    "RITUAL",
    "SYNCHRO",
    "XYZ",
    "LINK",
    "PENDULUM",
    "QUICK_PLAY",
    "CONTINUOUS",
    "EQUIP",
    "FIELD",
    "COUNTER",
    "TRAP_MONSTER",
    "TOKEN",
    "SKILL",
    "MAXIMUM",
    "ARMOR",
]
ACTIONS = [
    "SPECIAL_SUMMON",
    "NORMAL_SUMMON",
    "TRIBUTE_SUMMON",
    "FUSION_SUMMON",
    "RITUAL_SUMMON",
    "SYNCHRO_SUMMON",
    "XYZ_SUMMON",
    "LINK_SUMMON",
    "ADD_TO_HAND",
    "SEARCH",
    "DRAW",
    "SEND_TO_GRAVEYARD",
    "MILL",
    "BANISH",
    "RETURN_TO_HAND",
    "RETURN_TO_DECK",
    "RETURN_TO_EXTRA_DECK",
    "DISCARD",
    "TRIBUTE",
    "DETACH",
    "ATTACH",
    "EXCAVATE",
    "REVEAL",
    "SHUFFLE",
    "SET_CARD",
    "EQUIP",
    "GAIN_CONTROL",
    "DESTROY",
    "NEGATE",
    "NEGATE_ACTIVATION",
    "NEGATE_EFFECTS",
    "CHANGE_POSITION",
    "INCREASE_ATK",
    "DECREASE_ATK",
    "INCREASE_DEF",
    "DECREASE_DEF",
    "CHANGE_ATK",
    "CHANGE_NAME",
    "CHANGE_ATTRIBUTE",
    "CHANGE_RACE",
    "CHANGE_LEVEL",
    "CHANGE_SCALE",
    "COPY_EFFECT",
    "ATTACK_DIRECTLY",
    "INFLICT_DAMAGE",
    "PIERCING_DAMAGE",
    "PAY_LP",
    "PREVENT_DESTRUCTION",
    "PREVENT_ACTIVATION",
    "PREVENT_ATTACK",
    "PREVENT_SUMMON",
    "PREVENT_TARGETING",
]
ZONES = [
    "DECK",
    "EXTRA_DECK",
    "HAND",
    "GRAVEYARD",
    "BANISHED",
    "FIELD",
    "MONSTER_ZONE",
    "SPELL_TRAP_ZONE",
    "PENDULUM_ZONE",
    "FIELD_ZONE",
    "ANYWHERE",
]
ROLES = [
    "RESTRICTION",
    "CONDITION",
    "COST",
    "TARGET",
    "RESOLUTION",
    "UNKNOWN",
]
UNIT_KINDS = [
    "NUMBERED",
    "UNNUMBERED",
    "RESTRICTION",
    "MATERIAL",
]
SCOPES = [
    "MAIN",
    "MONSTER",
    "PENDULUM",
]
STATUSES = [
    "OK",
    "PARTIAL",
    "UNRESOLVED",
]
EXTRACTED_BY = ("rule", "grammar", "llm")
SUBJECTS = [
    "SELF",
    "OPPONENT",
    "PLAYER",
    "ANY",
    "UNKNOWN",
]
TRI = ("TRUE", "FALSE", "UNKNOWN")

# Bits of the binary card format.
ATTRIBUTE_BIT = {
    "EARTH": 0x1,
    "WATER": 0x2,
    "FIRE": 0x4,
    "WIND": 0x8,
    "LIGHT": 0x10,
    "DARK": 0x20,
    "DIVINE": 0x40,
}
ATTRIBUTES = list(ATTRIBUTE_BIT)
RACE_BIT = {
    "WARRIOR": 0x1,
    "SPELLCASTER": 0x2,
    "FAIRY": 0x4,
    "FIEND": 0x8,
    "ZOMBIE": 0x10,
    "MACHINE": 0x20,
    "AQUA": 0x40,
    "PYRO": 0x80,
    "ROCK": 0x100,
    "WINGED_BEAST": 0x200,
    "PLANT": 0x400,
    "INSECT": 0x800,
    "THUNDER": 0x1000,
    "DRAGON": 0x2000,
    "BEAST": 0x4000,
    "BEAST_WARRIOR": 0x8000,
    "DINOSAUR": 0x10000,
    "FISH": 0x20000,
    "SEA_SERPENT": 0x40000,
    "REPTILE": 0x80000,
    "PSYCHIC": 0x100000,
    "DIVINE_BEAST": 0x200000,
    "CREATOR_GOD": 0x400000,
    "WYRM": 0x800000,
    "CYBERSE": 0x1000000,
    "ILLUSIONIST": 0x2000000,
}
RACES = list(RACE_BIT)
# Type bits above those of the category.
TYPE_BIT = {
    "NORMAL": 0x10,
    "EFFECT": 0x20,
    "FUSION": 0x40,
    "RITUAL": 0x80,
    "TRAP_MONSTER": 0x100,
    "SPIRIT": 0x200,
    "UNION": 0x400,
    "GEMINI": 0x800,
    "TUNER": 0x1000,
    "SYNCHRO": 0x2000,
    "TOKEN": 0x4000,
    "MAXIMUM": 0x8000,
    "QUICK_PLAY": 0x10000,
    "CONTINUOUS": 0x20000,
    "EQUIP": 0x40000,
    "FIELD": 0x80000,
    "ACTION": 0x100000,
    "FLIP": 0x200000,
    "PENDULUM": 0x400000,
    "XYZ": 0x800000,
    "LINK": 0x1000000,
    "TOON": 0x2000000,
    "ARMOR": 0x4000000,
    "SKILL": 0x8000000,
}
TYPE_BITS = list(TYPE_BIT)
# Of several bits the first of these counts.
FRAME_ORDER = [
    "LINK",
    "XYZ",
    "SYNCHRO",
    "FUSION",
    "RITUAL",
    "PENDULUM",
    "TOKEN",
    "SKILL",
    "NORMAL",
    "EFFECT",
]
SPELL_TRAP_ORDER = [
    "QUICK_PLAY",
    "FIELD",
    "EQUIP",
    "CONTINUOUS",
]
FLAGS = [
    "TUNER",
    "PENDULUM",
    "TOON",
    "SPIRIT",
    "UNION",
    "GEMINI",
    "FLIP",
    "TRAP_MONSTER",
    "ARMOR",
    "MAXIMUM",
]

# Frames and sub-types of the JSON dump.
FRAMES = {
    "normal": ("MONSTER", "NORMAL"),
    "effect": ("MONSTER", "EFFECT"),
    "ritual": ("MONSTER", "RITUAL"),
    "fusion": ("MONSTER", "FUSION"),
    "synchro": ("MONSTER", "SYNCHRO"),
    "xyz": ("MONSTER", "XYZ"),
    "link": ("MONSTER", "LINK"),
    "pendulum": ("MONSTER", "PENDULUM"),
    "normal_pendulum": ("MONSTER", "PENDULUM"),
    "effect_pendulum": ("MONSTER", "PENDULUM"),
    "ritual_pendulum": ("MONSTER", "PENDULUM"),
    "fusion_pendulum": ("MONSTER", "PENDULUM"),
    "synchro_pendulum": ("MONSTER", "PENDULUM"),
    "xyz_pendulum": ("MONSTER", "PENDULUM"),
    "spell": ("SPELL", None),
    "trap": ("TRAP", None),
    "skill": ("SPELL", "SKILL"),
    "token": ("MONSTER", "TOKEN"),
}
SUB_TYPES = {
    "Normal": "NORMAL",
    "Quick-Play": "QUICK_PLAY",
    "Continuous": "CONTINUOUS",
    "Equip": "EQUIP",
    "Field": "FIELD",
    "Counter": "COUNTER",
}
TYPE_TOKENS = [
    "link",
    "xyz",
    "synchro",
    "fusion",
    "ritual",
    "token",
]
FLAG_TOKENS = [
    "tuner",
    "toon",
    "spirit",
    "union",
    "gemini",
    "flip",
]
# Other spellings of races.
RACE_ALIASES = {"ANGEL": "FAIRY"}
