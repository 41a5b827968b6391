"""Surface vocabulary of the card texts. Words and patterns are those of the texts' wording."""

from __future__ import annotations

# Patterns of actions, in order of priority.
ACTION_PATTERNS = (
    ("SPECIAL_SUMMON", "特殊召唤"),
    ("NORMAL_SUMMON", "通常召唤"),
    ("TRIBUTE_SUMMON", "上级召唤|解放召唤|祭品召唤"),
    ("FUSION_SUMMON", "融合召唤"),
    ("RITUAL_SUMMON", "仪式召唤"),
    ("SYNCHRO_SUMMON", "同步召唤|同调召唤"),
    ("XYZ_SUMMON", "超量召唤|XYZ召唤"),
    ("LINK_SUMMON", "连接召唤|链接召唤"),
    ("RETURN_TO_EXTRA_DECK", "回到额外卡组|返回额外卡组"),
    ("RETURN_TO_DECK", "回到卡组|返回卡组|回到牌组"),
    ("RETURN_TO_HAND", "回到手卡|回到手牌|返回手卡"),
    ("MILL", "从自己卡组上面把[^。；]*送去墓地"),
    ("SEND_TO_GRAVEYARD", "送去墓地|送去目的"),
    ("ADD_TO_HAND", "加入手卡|加入手牌|加进手卡"),
    ("DRAW", r"抽卡|抽\d+张"),
    ("BANISH", "除外"),
    ("DESTROY", "破坏"),
    ("NEGATE_ACTIVATION", "发动无效"),
    ("NEGATE_EFFECTS", "效果无效|无效化"),
    ("NEGATE", "无效"),
    ("DISCARD", "丢弃"),
    ("TRIBUTE", "解放"),
    ("DETACH", "取除|去除"),
    ("PAY_LP", r"支付\d+基本分|支付\d+点|支付基本分"),
    ("EQUIP", "给那只[^。；]*装备|当作装备卡|装备卡使用"),
    ("GAIN_CONTROL", "得到[^。；]*控制权|控制权"),
    ("CHANGE_POSITION", "变成守备表示|变成攻击表示|变更表示形式|变成里侧"),
    ("INCREASE_ATK", "攻击力上升"),
    ("DECREASE_ATK", "攻击力下降|攻击力降低"),
    ("INCREASE_DEF", "守备力上升"),
    ("DECREASE_DEF", "守备力下降|守备力降低"),
    ("CHANGE_NAME", "卡名当作|卡名变成|卡名视为"),
    ("CHANGE_ATTRIBUTE", "属性变成|属性当作|当作[^。；]*属性"),
    ("CHANGE_RACE", "种族变成|种族当作"),
    ("CHANGE_LEVEL", "等级变成|星级变成"),
    ("CHANGE_SCALE", "刻度变成|灵摆刻度变成"),
    ("ATTACK_DIRECTLY", "直接攻击"),
    ("INFLICT_DAMAGE", "给与[^。；]*伤害|受到[^。；]*伤害|伤害"),
    ("PIERCING_DAMAGE", "给与[^。；]*战斗伤害[^。；]*穿透|穿透伤害"),
    ("SHUFFLE", "洗切|洗回|洗牌"),
    ("REVEAL", "翻开|给对方观看|相互确认|公开"),
    ("EXCAVATE", "从自己卡组上面翻开|翻开[^。；]*张"),
    ("SET_CARD", "盖放|放置"),
    ("COPY_EFFECT", "得到[^。；]*效果|当作[^。；]*效果使用"),
    ("PREVENT_TARGETING", "不会成为效果的对象|不能成为效果的对象"),
    ("PREVENT_DESTRUCTION", "不会被[^。；]*破坏|不会被战斗破坏|不会被效果破坏"),
    ("PREVENT_ACTIVATION", "不能把[^。；]*发动|不能发动"),
    ("PREVENT_ATTACK", "不能攻击宣言|不能攻击"),
    ("PREVENT_SUMMON", "不能特殊召唤|不能召唤"),
)
# Actions that may be a cost.
COST_ACTIONS = [
    "BANISH",
    "DISCARD",
    "TRIBUTE",
    "SEND_TO_GRAVEYARD",
    "MILL",
    "DETACH",
    "REVEAL",
    "SHUFFLE",
    "RETURN_TO_HAND",
    "RETURN_TO_DECK",
    "PAY_LP",
    "EXCAVATE",
]
# Where an action puts and takes cards if the text doesn't say.
DEFAULT_DESTINATION = {
    "SPECIAL_SUMMON": "MONSTER_ZONE",
    "NORMAL_SUMMON": "MONSTER_ZONE",
    "TRIBUTE_SUMMON": "MONSTER_ZONE",
    "FUSION_SUMMON": "MONSTER_ZONE",
    "RITUAL_SUMMON": "MONSTER_ZONE",
    "SYNCHRO_SUMMON": "MONSTER_ZONE",
    "XYZ_SUMMON": "MONSTER_ZONE",
    "LINK_SUMMON": "MONSTER_ZONE",
    "BANISH": "BANISHED",
    "SEND_TO_GRAVEYARD": "GRAVEYARD",
    "MILL": "GRAVEYARD",
    "DISCARD": "GRAVEYARD",
    "TRIBUTE": "GRAVEYARD",
    "DRAW": "HAND",
    "ADD_TO_HAND": "HAND",
    "RETURN_TO_HAND": "HAND",
    "RETURN_TO_DECK": "DECK",
    "RETURN_TO_EXTRA_DECK": "EXTRA_DECK",
    "SET_CARD": "SPELL_TRAP_ZONE",
}
DEFAULT_SOURCE = {"MILL": "DECK", "DRAW": "DECK"}
# Actions that leave a card which later text may refer to.
PRODUCING = [
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
    "RETURN_TO_HAND",
    "SET_CARD",
    "EQUIP",
]
# Words of zones, in order of priority, and the words that lead to a destination.
ZONE_WORDS = {
    "额外卡组": "EXTRA_DECK",
    "卡组": "DECK",
    "手卡": "HAND",
    "手牌": "HAND",
    "墓地": "GRAVEYARD",
    "除外状态": "BANISHED",
    "除外区": "BANISHED",
    "场上": "FIELD",
    "怪兽区域": "MONSTER_ZONE",
    "魔法与陷阱区域": "SPELL_TRAP_ZONE",
    "灵摆区域": "PENDULUM_ZONE",
    "场地区域": "FIELD_ZONE",
}
OWNERS = "自己|对方|双方"
DESTINATION_VERBS = "到|回到|返回|加入|送去|送回|盖上|放置到|特殊召唤到"
# Patterns of zones that are only mentioned, in order of priority.
ZONE_PATTERNS = (
    ("EXTRA_DECK", "额外卡组"),
    ("DECK", "卡组|牌组|卡顶"),
    ("HAND", "手卡|手牌"),
    ("GRAVEYARD", "墓地|坟场"),
    ("BANISHED", "除外状态|除外区|被除外的|除外了的|除外"),
    ("MONSTER_ZONE", "怪兽区域"),
    ("SPELL_TRAP_ZONE", "魔法与陷阱区域|魔法·陷阱区域|魔法陷阱区域"),
    ("PENDULUM_ZONE", "灵摆区域|P区域"),
    ("FIELD_ZONE", "场地区域"),
    ("FIELD", "场上"),
)
# The grammar of clauses. Anchors are in order of priority.
ANCHORS = ("才能把这张卡发动", "才能发动", "可以发动", "必定发动", "把这张卡发动", "发动")
TARGET = "以.+?为对象"
COST_VERBS = "除外|丢弃|解放|送去墓地|支付|取除|回到手卡|回到卡组|回到额外卡组|洗切|翻开|把这张卡|从自己卡组上面把|舍弃"
RESTRICTIONS = (
    "这个卡名的?[①②③④⑤⑥]?[和・、，,]?[①②③④⑤⑥]?的效果1回合(?:各能|只能|仅能)使用1次",
    "这个卡名的效果1回合只能使用1次",
    "「[^」]+」的效果1回合只能使用1次",
    "1回合1次",
    "不能通常召唤",
    "只能有1只表侧表示存在",
    "在规则上当作",
)
CONDITIONS = (
    "存在的场合",
    "的场合",
    ".+?时[，,]",
    "自己(?:主要|准备|结束|战斗|抽卡)阶段",
    "对方回合",
    "自己回合",
    "回合(?:内|中)",
    "这张卡(?:召唤|特殊召唤|反转|上级召唤|融合召唤|同步召唤|超量召唤|连接召唤)成功",
    "场上没有怪兽存在",
    "自己场上有",
    "只要这张卡",
)
LEADING_CONDITION = r"^(.+?(?:的场合|时|只要.+?))\s*[，,]\s*(.+)$"
ONCE_PER_TURN = ("1回合1次", "1回合各能使用1次")
ANAPHORS = ("那只", "那张", "那些", "那个", "其效果", "其")
NEGATED = r"(?:不能|不会|无法|不得|不必|不可|未能|不受|无效)\s*$"
NEGATED_NEAR = "(?:不能|不会|无法|不得|不可|未能|不受)[^。；，,]{0,6}$"
# How sure a clause's role is.
ROLE_CONFIDENCE = {"RESTRICTION": 0.8, "TARGET": 0.9, "COST": 0.75, "CONDITION": 0.7, "RESOLUTION": 0.6, "UNKNOWN": 0.2}
# Measures.
COUNT = r"(\d+)\s*(?:只|张|个|枚)"
COUNT_ALL = "全部|双方|所有"
UP_TO = r"最多(\d+)\s*(?:只|张|个|枚)"
LEVEL_MOST = r"(\d+)星以下|等级(\d+)以下|Lv\.?(\d+)以下"
LEVEL_LEAST = r"(\d+)星以上|等级(\d+)以上"
LEVEL = r"等级(\d+)|(\d+)星|Lv\.?(\d+)"
RANK = r"阶级(\d+)|(\d+)阶"
LINK = r"连接(\d+)|LINK-?(\d+)"
ATK_BOUND = "攻击力(\\d+)(以下|以上)"
DEF_BOUND = "守备力(\\d+)(以下|以上)"
# The grammar of units.
MARKERS = "①②③④⑤⑥⑦⑧⑨⑩"
BULLET = "●"
MATERIAL = (
    r"^\s*(?:「[^」]+」\s*[＋+]\s*)?「?[^」]+?」?\s*[＋+]\s*「[^」]+」\s*$",
    r"^[^\n。：①]*[＋+][^\n。：①]*$|^(?:\d+只以上|[^\n。：①]{0,20})(?:怪兽|衍生物|调整)[^\n。：①]{0,10}$",
)
GLOBAL_RESTRICTION = r"(?:这个卡名|「[^」]+」)[^。]*?1回合(?:各能|只能|仅能|各只能)使用\d*次"
PURE_RESTRICTION = "不能通常召唤|只能有1只表侧表示存在|在规则上当作"
# Words of races, attributes, card types and tags.
RACE_WORDS = {
    "龙族": "DRAGON",
    "魔法师族": "SPELLCASTER",
    "战士族": "WARRIOR",
    "兽战士族": "BEAST_WARRIOR",
    "兽族": "BEAST",
    "鸟兽族": "WINGED_BEAST",
    "恶魔族": "FIEND",
    "天使族": "FAIRY",
    "不死族": "ZOMBIE",
    "机械族": "MACHINE",
    "水族": "AQUA",
    "炎族": "PYRO",
    "岩石族": "ROCK",
    "植物族": "PLANT",
    "昆虫族": "INSECT",
    "雷族": "THUNDER",
    "恐龙族": "DINOSAUR",
    "鱼族": "FISH",
    "海龙族": "SEA_SERPENT",
    "爬虫类族": "REPTILE",
    "念动力族": "PSYCHIC",
    "幻神兽族": "DIVINE_BEAST",
    "创造神族": "CREATOR_GOD",
    "幻龙族": "WYRM",
    "电子界族": "CYBERSE",
    "幻想魔族": "ILLUSIONIST",
}
ATTRIBUTE_WORDS = {
    "地属性": "EARTH",
    "水属性": "WATER",
    "炎属性": "FIRE",
    "风属性": "WIND",
    "光属性": "LIGHT",
    "暗属性": "DARK",
    "神属性": "DIVINE",
}
TYPE_WORDS = {
    "怪兽": "MONSTER",
    "魔法卡": "SPELL",
    "陷阱卡": "TRAP",
    "魔法·陷阱卡": "SPELL_TRAP",
    "魔法与陷阱卡": "SPELL_TRAP",
    "灵摆怪兽": "MONSTER",
    "效果怪兽": "MONSTER",
}
TAG_WORDS = {
    "调整": "TUNER",
    "协调": "TUNER",
    "灵摆": "PENDULUM",
    "反转": "FLIP",
    "二重": "GEMINI",
    "同盟": "UNION",
    "灵魂": "SPIRIT",
    "卡通": "TOON",
    "衍生物": "TOKEN",
}
