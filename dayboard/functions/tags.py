"""Rule-based type, genres and flags of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import NIGHT, includes_weekend, minutes, strict_date
from .text import contains_any, tag_search_text

# Words of each rule, in the order in which rules are tried.
SPORTS = ["試合", "大会", "選手権", "マラソン", "駅伝", "サッカー", "野球", "バスケ", "バスケット", "バレーボール", "テニス", "ラグビー", "ゴルフ", "柔道", "剣道", "相撲", "陸上", "水泳", "トライアスロン", "スポーツ", "リーグ", "フットサル", "パブリックビューイング"]
TYPE_RULES = {
    "sports": SPORTS,
    "exhibition": ["展覧会", "企画展", "特別展", "常設展", "展示", "コレクション展", "作品展", "写真展", "漆芸展"],
    "performance": ["公演", "ライブ", "コンサート", "concert", "live", "tour", "演奏会", "舞台", "ミュージカル", "ステージ", "リサイタル", "吹奏楽", "オーケストラ", "orchestra", "オンザロード", "ontheroad", "楽団", "交響楽団", "歌謡祭", "dance", "演芸"],
    "screening": ["上映", "映画", "シネマ", "映画祭"],
    "workshop": ["ワークショップ", "体験", "教室", "レッスン", "講習会", "つくろう", "作り", "づくり", "バックヤードツアー", "見学ツアー"],
    "lecture": ["講演", "講座", "セミナー", "トーク", "トークショー", "シンポジウム", "説明会", "報告会", "研究会", "会議", "フォーラム", "検定", "学会", "カンファレンス", "商談会", "就職", "インターンシップ"],
    "business": ["フェア", "expo", "ショウ", "合同企業説明会", "合同説明会", "転職フェア", "就活", "キャリア", "ビジネス", "展示商談会"],
    "festival": ["祭", "フェス", "フェスティバル", "マルシェ", "市", "市場", "マーケット"],
    "special_open": ["特別公開", "限定公開", "夜間開館", "延長開館", "特別開館"],
    "event": ["イベント", "催し", "催事"],
}
GENRE_RULES = {
    "sports": SPORTS,
    "art": ["美術", "アート", "展覧会", "企画展"],
    "history": ["歴史", "史跡", "文化財", "遺跡"],
    "culture": ["文化", "伝統", "工芸", "民芸"],
    "science": ["科学", "サイエンス", "技術", "プラネタリウム"],
    "music": ["音楽", "コンサート", "ライブ", "演奏", "tour", "concert", "orchestra", "リサイタル", "ピアノ"],
    "theater": ["演劇", "舞台", "ミュージカル", "映画", "上映"],
    "kids": ["子ども", "こども", "キッズ", "親子"],
    "local": ["地域", "地元", "まち", "商店街"],
    "food": ["グルメ", "食", "フード", "マルシェ", "市場", "物産"],
    "nature": ["自然", "公園", "山", "花", "海", "森"],
    "business": ["ビジネス", "キャリア", "就職", "インターンシップ", "商談"],
}
FLAG_RULES = {
    "limited": ["限定", "先着", "抽選"],
    "free": ["無料", "free"],
    "paid": ["有料", "円", "料金"],
    "night": ["夜間", "ナイト", "夜"],
    "weekend": [],
    "family": ["親子", "ファミリー", "子ども", "こども", "キッズ"],
    "reservation_required": ["要予約", "予約制", "事前予約"],
    "sold_out": ["予定枚数終了", "完売", "soldout"],
}


def first_rule(text: Column, rules: dict[str, list[str]], default: str = "other") -> Column:
    """Name of the first rule with a word that the text contains."""
    out = F.lit(default)
    for key, words in reversed(rules.items()):
        out = F.when(contains_any(text, [w.lower() for w in words]), key).otherwise(out)
    return out


def matching_rules(hits: dict[str, Column], most: int = 2) -> Column:
    """Names of the first rules that hit, in the order of rules."""
    return F.slice(F.array_compact(F.array(*(F.when(c, k) for k, c in hits.items()))), 1, most)


def event_type(title: Column, venue_category: Column) -> Column:
    text = tag_search_text(search_text(title, venue_category))
    return first_rule(text, TYPE_RULES)


def search_text(title: Column, venue_category: Column) -> Column:
    """What rules look at: the title and the venue's category, nothing else."""
    return F.concat_ws(" ", title, venue_category)


def unless_tagged(old: Column, new: Column, *, overwrite: bool) -> Column:
    """The new tags; without ``overwrite`` those rows keep theirs whose type is not blank."""
    if overwrite:
        return new
    return F.when(F.coalesce(F.trim(old["type"]), F.lit("")) != "", old).otherwise(new)


def labels_of(keys: Column, labels: dict[str, str]) -> Column:
    """Labels of an array of keys; a key without a label stays."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(table, k), k))


def unlabelled(keys: Column, labels: dict[str, str]) -> Column:
    """Keys that have no label."""
    return F.filter(keys, lambda k: ~k.isin(list(labels)))


def genres(text: Column, rules: dict[str, list[str]] = GENRE_RULES) -> Column:
    t = tag_search_text(text)
    return matching_rules({k: contains_any(t, [w.lower() for w in words]) for k, words in rules.items()})


def flags(text: Column, price: Column, start: Column, end: Column, first: Column, last: Column) -> Column:
    """Free and paid look at the price alone; night at words or times from 18:00; weekend at the dates."""
    t, p = tag_search_text(text), tag_search_text(price)
    hit = {k: contains_any(p if k in ("free", "paid") else t, [w.lower() for w in words]) for k, words in FLAG_RULES.items()}
    late = lambda x: F.coalesce(minutes(x) >= NIGHT, F.lit(False))
    hit["night"] = hit["night"] | late(start) | late(end)
    hit["weekend"] = includes_weekend(strict_date(first), strict_date(last))
    return matching_rules(hit)
