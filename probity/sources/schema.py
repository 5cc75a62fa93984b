"""Schemas of the 22 stored tables. Nothing is inferred: readers pass these."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Names and types of the stored columns.
DDL = {
    "posts": "id BIGINT, owner_id BIGINT, post_id BIGINT, url STRING, date_text STRING, timestamp BIGINT, text STRING, likes BIGINT, reposts BIGINT, comments BIGINT, views BIGINT, pinned BOOLEAN, is_comments_closed BOOLEAN, collected_at BIGINT",
    "post_attachments": "id BIGINT, post_id BIGINT, kind STRING, href STRING, src STRING, extra_json STRING",
    "post_hashtags": "id BIGINT, post_id BIGINT, tag STRING",
    "post_mentions": "id BIGINT, post_id BIGINT, handle STRING",
    "post_urls": "id BIGINT, post_id BIGINT, url STRING",
    "comments": "id BIGINT, post_row_id BIGINT, owner_id BIGINT, post_id BIGINT, comment_id BIGINT, from_id BIGINT, author_name STRING, reply_to_comment_id BIGINT, date_text STRING, timestamp BIGINT, text STRING, likes BIGINT, is_deleted BOOLEAN, is_edited BOOLEAN, collected_at BIGINT",
    "comment_attachments": "id BIGINT, comment_id_fk BIGINT, kind STRING, href STRING, src STRING, extra_json STRING",
    "comment_hashtags": "id BIGINT, comment_id_fk BIGINT, tag STRING",
    "comment_mentions": "id BIGINT, comment_id_fk BIGINT, handle STRING",
    "comment_urls": "id BIGINT, comment_id_fk BIGINT, url STRING",
    "profiles": "id BIGINT, user_id BIGINT, screen_name STRING, domain STRING, first_name STRING, last_name STRING, nickname STRING, sex INT, bdate STRING, bdate_visibility INT, city_id BIGINT, city_title STRING, country_id BIGINT, country_title STRING, home_town STRING, verified BOOLEAN, is_sber_verified BOOLEAN, is_tinkoff_verified BOOLEAN, is_esia_verified BOOLEAN, is_nft BOOLEAN, is_followers_mode_on BOOLEAN, no_index STRING, wall_default STRING, "
    "status STRING, activity STRING, about STRING, interests STRING, books STRING, tv STRING, quotes STRING, games STRING, movies STRING, music STRING, site STRING, mobile_phone STRING, home_phone STRING, photo_50 STRING, photo_100 STRING, photo_200 STRING, photo_400 STRING, photo_max STRING, photo_base STRING, photo_avg_color STRING, photo_id STRING, cover_photo_url STRING, online BOOLEAN, last_seen_ts BIGINT, last_seen_platform BIGINT, online_app_id BIGINT, followers_count BIGINT, collected_at BIGINT, updated_at BIGINT, registered_at DATE, is_bot INT",
    "profile_counters": "id BIGINT, profile_id BIGINT, albums BIGINT, audios BIGINT, followers BIGINT, friends BIGINT, groups BIGINT, online_friends BIGINT, pages BIGINT, photos BIGINT, subscriptions BIGINT, videos BIGINT, video_playlists BIGINT, mutual_friends BIGINT, clips_followers BIGINT, clips_views BIGINT, clips_likes BIGINT",
    "profile_personal": "id BIGINT, profile_id BIGINT, alcohol BIGINT, inspired_by STRING, life_main BIGINT, people_main BIGINT, religion STRING, religion_id BIGINT, smoking BIGINT",
    "profile_languages": "id BIGINT, profile_id BIGINT, lang STRING",
    "profile_universities": "id BIGINT, profile_id BIGINT, university_id BIGINT, name STRING, faculty_id BIGINT, faculty_name STRING, chair_id BIGINT, chair_name STRING, graduation INT",
    "profile_schools": "id BIGINT, profile_id BIGINT, school_id BIGINT, name STRING, year_from INT, year_to INT, year_graduated INT, clazz STRING, speciality STRING",
    "profile_careers": "id BIGINT, profile_id BIGINT, company STRING, position STRING, city_id BIGINT, city_title STRING, from_year INT, until_year INT",
    "profile_friends_sample": "id BIGINT, profile_id BIGINT, friend_user_id BIGINT, domain STRING, first_name STRING, last_name STRING, sex INT, online BOOLEAN, photo_50 STRING, photo_100 STRING, photo_200 STRING",
    "profile_followers_sample": "id BIGINT, profile_id BIGINT, follower_user_id BIGINT, first_name STRING, last_name STRING, sex INT, photo_50 STRING, photo_100 STRING, photo_200 STRING, online BOOLEAN",
    "profile_subscriptions_sample": "id BIGINT, profile_id BIGINT, group_id BIGINT, name STRING, screen_name STRING, type STRING, description STRING, status STRING, photo_100 STRING, photo_200 STRING",
    "profile_photos": "id BIGINT, profile_id BIGINT, photo_id BIGINT, album_id BIGINT, owner_id BIGINT, date BIGINT, square_crop STRING, url_base STRING, sizes_json STRING",
    "profile_videos_sample": "id BIGINT, profile_id BIGINT, owner_id BIGINT, video_id BIGINT, date BIGINT, title STRING, description STRING, duration BIGINT, views BIGINT, comments BIGINT, likes BIGINT, reposts BIGINT, player_url STRING, image_url STRING, direct_url STRING, share_url STRING",
}
#: Natural keys.
KEYS = {
    "posts": ["owner_id", "post_id"], "comments": ["owner_id", "post_id", "comment_id"], "profiles": ["user_id"], "post_attachments": ["post_id", "kind", "href", "src"], "post_hashtags": ["post_id", "tag"], "post_mentions": ["post_id", "handle"], "post_urls": ["post_id", "url"],
    "comment_attachments": ["comment_id_fk", "kind", "href", "src"], "comment_hashtags": ["comment_id_fk", "tag"], "comment_mentions": ["comment_id_fk", "handle"], "comment_urls": ["comment_id_fk", "url"], "profile_counters": ["profile_id"], "profile_personal": ["profile_id"],
    "profile_languages": ["profile_id", "lang"], "profile_friends_sample": ["profile_id", "friend_user_id"], "profile_followers_sample": ["profile_id", "follower_user_id"], "profile_subscriptions_sample": ["profile_id", "group_id"], "profile_photos": ["profile_id", "photo_id"], "profile_videos_sample": ["profile_id", "owner_id", "video_id"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], DDL[name])


def read(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A stored table with its declared schema: Parquet, or CSV with a header."""
    reader = spark.read.schema(DDL[name])
    return reader.option("header", True).csv(f"{root}/{name}") if fmt == "csv" else reader.format(fmt).load(f"{root}/{name}")


def tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read(spark, root, name, fmt) for name in DDL}
