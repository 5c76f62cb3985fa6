"""Lexicons of the annotation operators (own wording); replace them by parameters for another domain.

ASCII terms of one or more words match at word boundaries, terms in other scripts as substrings.
"""

TOPICS = {
    "audio": ["theme", "choir", "drum", "harp", "piano", "cue", "配乐", "音乐", "竖琴", "音楽", "музыка"],
    "economy": ["coins", "bundle", "gacha", "auction", "trade", "resell", "gift pack", "金币", "礼包", "卡池", "コイン", "монет"],
    "multiplayer": ["guild", "clan", "queued", "matchmaking", "lobby", "server", "guild raid", "公会", "联机", "ギルド", "гильд"],
    "performance": ["crashes", "frames", "loading", "kicked", "seconds", "frame rate", "掉线", "闪退", "帧", "프레임", "вылет"],
    "progression": ["rank", "tutorial", "quest", "reroll", "expire", "daily list", "教学关", "任务", "委托", "クエスト", "задани"],
    "story": ["chapter", "epilogue", "prologue", "translation", "remembers", "side story", "剧情", "序章", "台词", "物語", "сюжет"],
}
POSITIVE = ["brilliant", "charming", "cozy", "crisp", "delightful", "fair", "generous", "gorgeous", "polished", "rewarding", "smooth", "worth it", "顺滑", "良心", "惊艳", "最高", "отличн"]
NEGATIVE = ["bloated", "broke", "clunky", "confusing", "crashes", "dull", "hollow", "sluggish", "stale", "tedious", "vanished", "let down", "敷衍", "失望", "诡异", "最悪", "ужасн"]
NEUTRAL = ["version", "patch", "update", "updates", "版本", "更新"]
BEHAVIOURS = {
    "farming": ["farming", "stack", "spent"],
    "leaving": ["uninstalled", "quit"],
    "paying": ["paid", "buy", "coins"],
    "returning": ["back", "revisit", "again"],
}
REQUESTS = [r"\bplease let us\b", r"\bshould\b", r"\bwhy is there no\b", r"\bi would trade\b", r"希望能", r"应该"]
PAINS = {"crash or disconnect": ["crashes", "kicked", "vanished"], "slow or waiting": ["loading", "seconds", "minutes"], "cost": ["coins", "cost", "price"]}
NEEDS = {"economy": "fair prices", "multiplayer": "reliable company", "performance": "stable play", "progression": "respected time", "story": "clear telling", "audio": "fitting sound"}
GAME_TERMS = ["boss", "build", "chapter", "guild", "patch", "quest", "raid", "tutorial"]
