"""Inputs derived from the test tables, as SQL that Spark and DuckDB both run over whole tables."""

# captured responses with every kind of outcome.
RESPONSES = """SELECT page_id AS request_id, url AS final_url,
  CAST(CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END AS INT) AS status,
  CASE WHEN page_id % 4 = 0 THEN 'CloudFlare' ELSE 'nginx' END AS server,
  CASE WHEN page_id % 13 = 0 THEN 'Challenge' ELSE 'none' END AS mitigated,
  concat(
    CASE WHEN page_id % 7 = 0 THEN concat('<p>', CASE page_id % 9 WHEN 0 THEN 'Just A Moment' WHEN 1 THEN 'Enable JavaScript and cookies to continue'
      WHEN 2 THEN 'CF-challenge-running' WHEN 3 THEN 'cf-please-wait' WHEN 4 THEN '__cf_chl_tk' WHEN 5 THEN 'DDoS-Guard'
      WHEN 6 THEN 'Access Denied' WHEN 7 THEN '人机验证' ELSE '访问验证' END, '</p>') ELSE '' END,
    CASE page_id % 12 WHEN 5 THEN '<script src="/cdn-cgi/challenge-platform/scripts/jsd/main.js"></script>'
      WHEN 7 THEN '<script src="/cdn-cgi/Challenge-Platform/h/b/x"></script>' WHEN 9 THEN '<script>window._cf_chl_opt=1</script>' ELSE '' END,
    CASE page_id % 11 WHEN 3 THEN '<a class="Enter-Btn" href="?SafeId=1">满18岁</a>' WHEN 6 THEN '<a class="enter-btn" href="?safeid=1">18</a>' ELSE '' END,
    html) AS body,
  CASE WHEN page_id % 23 = 0 THEN 'timeout' END AS fetch_error
FROM pages"""

# parameter rows; a NULL value means the key is absent.
PARAMS = """SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  '
       WHEN o_orderkey % 2 = 1 THEN concat('  ord-', CAST(o_orderkey AS STRING), ' ') ELSE concat('ORD-', CAST(o_orderkey AS STRING)) END AS code,
  CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(o_custkey % 40 AS STRING) END AS page,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat(o_orderpriority, ' ~*&ü') END AS keyword,
  CASE o_orderstatus WHEN 'O' THEN concat(' a = ', CAST(o_custkey AS STRING), ' ; broken ; b=two=parts ; empty= ') WHEN 'F' THEN ' ' END AS cookie,
  CASE o_orderstatus
    WHEN 'O' THEN concat('  CUSTOMER#', lpad(CAST(o_custkey AS STRING), 9, '0'), ' ')
    WHEN 'F' THEN concat('Pair ', CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING))
    ELSE CASE o_orderpriority WHEN '5-LOW' THEN '   ' ELSE concat('no such ', o_orderpriority) END END AS name
FROM orders"""

# a lookup with unique names, aliases shared by two rows, and rows without a value.
INDEX = """SELECT c_custkey AS pos, c_name AS name, CASE WHEN c_acctbal < 0 THEN ' ' ELSE concat(' ', CAST(c_custkey AS STRING)) END AS id,
  lower(c_name) AS alias1, concat('pair ', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)) AS alias2, c_mktsegment AS grp FROM customer"""

# leaves of an image tree: group i, entry j.
ASSETS = """SELECT p_partkey AS tree, p_brand AS grp, concat(p_type, '.', CAST(p_size AS STRING), '.jpg') AS entry,
  concat(p_name, ' ä+', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('?t=', CAST(p_partkey AS STRING)) END) AS file FROM part"""

# captures of many sources; cache copies and downloads, good and bad.
SNAPSHOTS = """SELECT event_id AS snapshot_id, user_id AS source, ts AS captured_at, event_type <> 'error' AS ok,
  CASE WHEN event_type IN ('signup', 'error') THEN 'download' ELSE 'cache' END AS kind, props AS body FROM events"""

# JSON bodies, one per order.
JSON_ORDERS = """SELECT o_orderkey AS doc_id, o_custkey AS ck, o_orderpriority AS prio, o_totalprice AS price, o_orderstatus AS st, o_orderdate AS od,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '{"query": [1, ' ELSE concat(
   '{"query":{"total":', CAST(o_custkey % 7 AS STRING), ',"search":[{"title":" ', o_orderpriority, ' ","pageid":', CAST(o_orderkey AS STRING), ',"w":', CAST(o_custkey AS STRING), '.5}',
   CASE WHEN o_orderstatus = 'O' THEN concat(',{"title":null,"pageid":', CAST(o_custkey AS STRING), ',"w":', CAST(o_custkey AS STRING), '}') ELSE '' END, ']},',
   '"entities":{"Q', CAST(o_custkey AS STRING), '":{"id":"Q', CAST(o_custkey AS STRING), '","time":"+', substr(CAST(o_orderdate AS STRING), 1, 10), 'T00:00:00Z"},',
   '"P1":{"id":"P1","time":null}},"flag":', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END, '} trailing') END AS body FROM orders"""

# knowledge base around customers. Some pages sit under another title, some search hits lead nowhere.
KB_SUMMARY = """SELECT 'en' AS lang, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('Page ', c_name) ELSE c_name END AS title, c_custkey AS pageid,
  CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN ' ' ELSE concat('Q', CAST(c_custkey AS STRING)) END AS entity_id,
  c_mktsegment AS description, concat('https://kb.example/', CAST(c_custkey AS STRING)) AS page_url FROM customer"""
KB_SEARCH = """SELECT 'en' AS lang, c_name AS query, CAST(2 AS INT) AS rank, 'Customer#000000001' AS title FROM customer
UNION ALL SELECT 'en', c_name, CAST(1 AS INT), CASE c_mktsegment WHEN 'BUILDING' THEN concat('Page ', c_name) WHEN 'MACHINERY' THEN ' ' ELSE c_name END FROM customer
UNION ALL SELECT 'en', concat('Ghost ', n_name), CAST(1 AS INT), concat('Nowhere ', n_name) FROM nation"""
KB_ENTITY = """SELECT 'en' AS lang, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('Page ', c_name) ELSE c_name END AS title, concat('E', CAST(c_custkey AS STRING)) AS entity_id,
  CASE WHEN c_acctbal > 0 THEN concat('19', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-01-02') ELSE ' ' END AS birth_date,
  concat('QN', CAST(c_nationkey AS STRING)) AS country_qid, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'Q33999' END AS occupation_qid,
  CASE WHEN c_nationkey > 10 THEN concat('http://', CAST(c_custkey AS STRING), '.example') ELSE '' END AS official_website FROM customer"""
KB_CONTENT = """SELECT 'en' AS lang, s_name AS title, concat('text of ', s_name) AS wikitext FROM supplier
UNION ALL SELECT 'en', c_name, concat('text of ', c_name) FROM customer"""
# Records to enrich: order rows naming customers, ghosts and unknowns.
KB_RECORDS = """SELECT o_orderkey AS rec_id, CASE WHEN o_orderpriority = '5-LOW' THEN concat('Ghost ', n_name) WHEN o_orderpriority = '1-URGENT' THEN 'nobody' WHEN o_orderstatus = 'P' THEN '  '
  ELSE concat(' ', c_name, ' ') END AS name, concat('old/', CAST(o_orderkey AS STRING)) AS image
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

# F8: a paged listing, one page per captured page; items are the page's navigation links.
LISTING_LINK_ID = "CASE WHEN length(txt) % 4 = 1 OR length(txt) % 7 = 3 THEN '  ' ELSE lower(txt) END"
LISTING_LINK_URL = "CASE WHEN length(txt) % 7 = 3 THEN NULL ELSE href END"

# wikitext around whole documents.
WIKITEXT = """SELECT doc_id, lang, source, n_chars, text,
  concat(CASE WHEN lang = 'en' THEN '{{note|{{inner}} x}} {{hatnote}}\n' ELSE '' END,
    CASE WHEN n_chars % 2 = 0 THEN concat('{{Infobox item\n|name = ''''''N', CAST(doc_id AS STRING), '''''''\n| alt=\n|nick=first\n  second {{fact|third|4}}\n\n|skipped line\n|nick2 = [[Page|Label ', source, ']]\n|year=', CAST(1900 + doc_id % 100 AS STRING),
      '年\n|month=', CAST(1 + doc_id % 12 AS STRING), '\n|day=', CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(1 + doc_id % 28 AS STRING) END, '\n|height=about ', CAST(100 + doc_id % 90 AS STRING), ' cm<ref>r</ref>\n|width=\n|width_alt=', CAST(doc_id % 50 AS STRING),
      '\n|home={{jpn|a=[[Oslo]]|b= |Rome}}\n}}\n') ELSE '{{Infobox items|name=no}}\n' END,
    'Intro ''''bold'''' &amp; [[a b|c d]]<br/>next<ref name="x" /> {{bd|19|90}} {{Wayback|u=1}}{{JPN}} [https://x.example/p site]\n',
    '== ', CASE lang WHEN 'en' THEN 'History' WHEN 'fr' THEN 'Histoire' ELSE 'Other' END, ' ==\n', text, '\n\n\n\nend [[File:a.jpg|t]]\n',
    '=== Notes ===\nn\n== ', CASE WHEN lang = 'de' THEN 'Weblinks' ELSE 'Links' END, ' ==\n',
    CASE WHEN n_chars % 3 = 0 THEN '' ELSE concat('* {{ Twitter | joe', CAST(doc_id AS STRING), ' }}\n*[https://a.example/', CAST(doc_id AS STRING), ' Label ''''x''''] and [http://b.example]\n* plain\n* {{Instagram|pic|x}}\n') END) AS wikitext FROM documents"""
