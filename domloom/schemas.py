"""Schemas of the tables that the operators read and write (DDL strings)."""

from __future__ import annotations

PAGES = "page_id bigint, url string, html string"
NODES = (
    "page_id bigint, pre int, end int, level int, parent int, tag string, attrs map<string,string>, attr_names array<string>, "
    "attr_values array<string>, text string, tail string, sib int, n_sib int, nth_of_type int, n_of_type int, n_children int"
)
TEXT_NODES = "page_id bigint, seq int, owner int, is_tail boolean, text string"
LINKS = "page_id bigint, seq int, href string, abs_url string, anchor string, domain string"
FINGERPRINT = (
    "struct<tag:string,attr_names:array<string>,attr_values:array<string>,text:string,path:array<string>,parent_name:string,"
    "parent_attr_names:array<string>,parent_attr_values:array<string>,parent_text:string,siblings:array<string>,children:array<string>>"
)
STORE = f"site string, identifier string, version bigint, fingerprint {FINGERPRINT}"
REQUESTS = (
    "url string, sid string, method string, body binary, headers map<string,string>, priority int, dont_filter boolean, "
    "meta map<string,string>, callback string, retry_count int, seq bigint"
)
RESPONSES = (
    "url string, status int, reason string, body binary, encoding string, headers map<string,string>, request_headers map<string,string>, "
    "cookies map<string,string>, method string, history array<struct<url:string,status:int,reason:string>>, meta map<string,string>"
)
ITEMS = "page_id bigint, item variant"
SESSIONS = "sid string, kind string, is_default boolean"
PROXY_STATE = "proxy string, uses bigint, failures bigint, quarantine_until timestamp"
CURL = (
    "struct<method:string,url:string,params:map<string,string>,data:string,json_data:string,headers:map<string,string>,"
    "cookies:map<string,string>,proxy:string,follow_redirects:boolean,error:string>"
)
METADATA = (
    "struct<title:string,description:string,keywords:array<string>,author:string,canonical_url:string,og_title:string,og_description:string,"
    "og_image:string,og_type:string,og_site_name:string,twitter_card:string,twitter_title:string,twitter_description:string,"
    "twitter_image:string,robots:string,viewport:string,charset:string>"
)
