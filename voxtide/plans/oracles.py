"""Equivalent SQL for the queries, over the same tables and written independently of the operators."""

from __future__ import annotations

from voxtide.options import DetectorOptions
from voxtide.plans import views

_W = r"[\pZ\t-\r\x{85}]"

VIEWS = {
    "frames": """
        SELECT user_id AS file_id, event_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
               CASE WHEN value > 0 THEN round(20 * log10(value / 500), 6) ELSE '-infinity'::DOUBLE END AS dbfs
        FROM events""",
    "marks": "SELECT *, dbfs >= -20 AS above, dbfs < -26 AS below FROM frames",
    # Run lengths of loud and quiet frames up to each frame.
    "runs": """
        SELECT *,
               frame_idx - coalesce(max(CASE WHEN NOT above THEN frame_idx END) OVER w, -1) AS loud,
               frame_idx - coalesce(max(CASE WHEN NOT below THEN frame_idx END) OVER w, -1) AS quiet
        FROM marks WINDOW w AS (PARTITION BY file_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)""",
    "latched": """
        SELECT *, coalesce(last_value(CASE WHEN loud >= 2 THEN 1 WHEN quiet >= 3 THEN 0 END IGNORE NULLS)
                   OVER (PARTITION BY file_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS st FROM runs""",
    "rises": """
        SELECT *, sum(CASE WHEN st = 1 AND before = 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY file_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, coalesce(lag(st) OVER (PARTITION BY file_id ORDER BY frame_idx), 0) AS before FROM latched)""",
    "islands": """
        SELECT file_id, island, min(frame_idx) * 320 - 320 AS core_start,
               max(CASE WHEN NOT below THEN frame_idx + 1 END) * 320 AS voiced_end,
               (max(frame_idx) + 1) * 320 AS close_sample,
               bool_or(st = 0) AS closed
        FROM rises WHERE st = 1 OR before = 1 GROUP BY file_id, island""",
    "pieces": """
        SELECT file_id, island, greatest(core_start - 320, 0) AS s, least(close_sample, voiced_end + 320) AS e
        FROM islands WHERE voiced_end - core_start >= 640""",
    "utt": """
        SELECT conv_id AS file_id, turn AS idx, text, e - length(text) * 800 AS s, e
        FROM (SELECT *, sum(length(text) * 800 + CASE WHEN turn = 0 THEN 0 ELSE 8000 END)
                     OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM conversations)""",
    "det0": """
        SELECT file_id, idx, text, (file_id + 2 * idx) % 7 = 0 AS cut,
               greatest(s + ((file_id * 7 + idx * 13) % 5 - 2) * 1600, 0) AS s,
               e + ((file_id * 7 + idx * 13) % 5 - 2) * 1600 AS e
        FROM utt WHERE (file_id + idx) % 11 <> 0""",
    "det": """
        SELECT file_id, idx * 2 AS idx, s, CASE WHEN cut THEN s + (e - s) // 2 ELSE e END AS e,
               CASE WHEN cut THEN array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) // 2], ' ') ELSE text END AS text
        FROM det0
        UNION ALL
        SELECT file_id, idx * 2 + 1, s + (e - s) // 2, e,
               array_to_string(string_split(text, ' ')[len(string_split(text, ' ')) // 2 + 1:], ' ')
        FROM det0 WHERE cut""",
    "matched": """
        SELECT file_id, idx, s, e, ds, de, ov, sh FROM (
            SELECT u.file_id, u.idx, u.s, u.e, d.s AS ds, d.e AS de,
                   CASE WHEN d.s IS NOT NULL THEN least(u.e, d.e) - greatest(u.s, d.s) END AS ov,
                   coalesce(sum(CASE WHEN d.s IS NOT NULL THEN least(u.e, d.e) - greatest(u.s, d.s) END)
                            OVER (PARTITION BY u.file_id, u.idx), 0)::BIGINT AS sh,
                   row_number() OVER (PARTITION BY u.file_id, u.idx
                                      ORDER BY least(u.e, d.e) - greatest(u.s, d.s) DESC, d.s, d.e) AS rn
            FROM utt u LEFT JOIN det d ON d.file_id = u.file_id AND u.s < d.e AND u.e > d.s) WHERE rn = 1""",
    "shared": """
        SELECT u.file_id, sum(least(u.e, d.e) - greatest(u.s, d.s))::BIGINT AS n
        FROM utt u JOIN det d ON d.file_id = u.file_id AND u.s < d.e AND u.e > d.s GROUP BY u.file_id""",
    "rough": f"""
        SELECT file_id, idx AS cue_idx,
               s - CASE WHEN (file_id + idx * 3) % 4 = 0 THEN 12000 ELSE 0 END AS s,
               CASE WHEN (file_id + idx * 3) % 5 = 0 THEN s + 3 ELSE e END AS e,
               CASE WHEN (file_id + idx * 3) % 13 = 0 THEN '' ELSE trim(regexp_replace(text, '{_W}+', ' ', 'g')) END AS text
        FROM utt""",
    # The recursion itself, cue after cue.
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, e, cue_idx) AS cue_no,
               (s * 1000 + 8000) // 16000 AS sm, (e * 1000 + 8000) // 16000 AS em
        FROM rough WHERE s >= 0 AND e > s AND text <> ''""",
    "clamped": """
        SELECT file_id, cue_no, sm AS start_ms, greatest(sm + 1, em) AS end_ms, text FROM numbered WHERE cue_no = 1
        UNION ALL
        SELECT n.file_id, n.cue_no, greatest(c.end_ms, n.sm), greatest(greatest(c.end_ms, n.sm) + 1, n.em), n.text
        FROM clamped c JOIN numbered n ON n.file_id = c.file_id AND n.cue_no = c.cue_no + 1""",
    "resp0": """
        SELECT c.conv_id AS session_id, c.turn, c.text, f.text AS h
        FROM conversations c LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0""",
    "resp": """
        SELECT session_id, turn * 2 AS seq, text FROM resp0
        UNION ALL
        SELECT session_id, turn * 2 + 1,
               CASE WHEN turn = 1 THEN h || text || CASE WHEN session_id % 3 = 0 THEN '!' ELSE '' END
                    WHEN turn % 2 = 0 THEN h ELSE '  ' END FROM resp0""",
    "listing": """
        SELECT doc_id, '/in/' || source || '/' || lang || '/' || doc_id || ['.MP4', '.mp4', '.Mp4', '.wav'][doc_id % 4 + 1] AS path,
               source || '/' || lang || '/' || doc_id || ['.MP4', '.mp4', '.Mp4', '.wav'][doc_id % 4 + 1] AS relative_path,
               source || '/' || lang || '/' || doc_id || '.vtt' AS vtt,
               doc_id % 19 = 0 AS is_dir, n_chars AS length
        FROM documents""",
    "rec": "SELECT * FROM listing WHERE NOT is_dir AND doc_id % 4 <> 3",
    "work": "SELECT doc_id, path AS input_path, relative_path, '/out/' || vtt AS output_path FROM rec",
    "outs": """
        SELECT d.doc_id, '/out/' || source || '/' || lang || '/' || d.doc_id || '.vtt' AS lpath,
               CASE WHEN d.doc_id % 5 = 0 THEN upper('/out/' || source || '/' || lang || '/' || d.doc_id || '.vtt')
                    ELSE '/out/' || source || '/' || lang || '/' || d.doc_id || '.vtt' END AS path,
               d.doc_id % 23 = 0 AS is_dir
        FROM documents d JOIN labels USING (doc_id)""",
    "jobs": """
        SELECT user_id % 8 AS batch_id, user_id AS job_id, event_id AS seq, ts, value,
               CASE event_type WHEN 'view' THEN 'Pending' WHEN 'purchase' THEN 'Complete' WHEN 'error' THEN 'Failed'
                    ELSE 'Transcribing' END AS state,
               CASE event_type WHEN 'view' THEN 'ExtractingAudio' WHEN 'click' THEN 'DetectingSpeech'
                    WHEN 'purchase' THEN 'Transcribing' WHEN 'signup' THEN 'WritingVtt' ELSE 'Failed' END AS stage,
               CASE WHEN event_id % 50 < 3 THEN NULL ELSE least(greatest(value / 400, 0.0), 1.0) END AS progress,
               event_id % 3 = 0 AS forced
        FROM events""",
    # The state machine event by event: a terminal state ends it, an active job does not become pending again.
    "reached": """
        SELECT *, max(CASE state WHEN 'Pending' THEN 0 WHEN 'Transcribing' THEN 1 ELSE 2 END)
                   OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM jobs""",
    "now": """
        SELECT batch_id, job_id, max(seq) AS last_seq, max(progress) AS progress,
               coalesce((list(state ORDER BY seq) FILTER (state IN ('Complete', 'Failed')))[1],
                        CASE WHEN bool_or(state = 'Transcribing') THEN 'Transcribing' ELSE 'Pending' END) AS state
        FROM jobs GROUP BY ALL""",
    "run_a": """
        SELECT doc_id, source, source || '/' || lang || '/' || doc_id || '.vtt' AS relative_path,
               CASE WHEN doc_id % 29 = 0 THEN '' ELSE E'WEBVTT\\n\\n' END || CASE WHEN doc_id % 31 = 0 THEN '' ELSE text END AS text,
               doc_id % 29 <> 0 AS has_header
        FROM documents""",
    "run_b": """
        SELECT doc_id, source, source || '/' || lang || '/' || doc_id || '.vtt' AS relative_path,
               CASE WHEN doc_id % 29 = 0 THEN '' ELSE E'WEBVTT\\n\\n' END
               || CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 13 = 0 THEN text || '?' ELSE text END AS text,
               doc_id % 29 <> 0 AS has_header
        FROM documents WHERE doc_id % 17 <> 0""",
    "evidence": """
        SELECT a.doc_id, a.source, a.relative_path, '/out/' || a.relative_path AS output_path, b.doc_id IS NOT NULL AS "exists",
               coalesce(b.has_header, false) AS has_header,
               coalesce(b.has_header AND b.doc_id % 31 = 0, false) AS header_only,
               coalesce(length(b.text), 0) AS length, upper(sha256(b.text)) AS sha256, a.doc_id % 2 = 0 AS preseeded,
               a.doc_id % 2 = 0 AND b.doc_id IS NOT NULL AND a.text = b.text AS preserved
        FROM run_a a LEFT JOIN run_b b USING (doc_id)""",
    "scenarios": """
        SELECT ['success', 'cancellation', 'skip', 'collision-cancel', 'overwrite', 'write-failure', 'write-denied',
                'recognizer-failure', 'empty-response', 'mixed-failure'] AS names""",
    "job_rows": """
        SELECT e.*, names[substr(source, 4)::INT % 10 + 1] AS scenario,
               CASE WHEN doc_id % 6 = 1 THEN 'Failed' WHEN doc_id % 15 = 2 THEN 'Cancelled' ELSE 'Complete' END AS state,
               doc_id % 4 = 0 AS skipped, doc_id % 2 AS cue_count
        FROM evidence e, scenarios""",
    "broken_jobs": """
        SELECT source AS run_id, scenario, output_path, unnest(list_concat(
            CASE WHEN "exists" AND NOT has_header THEN ['output without header'] ELSE [] END,
            CASE WHEN scenario IN ('success', 'skip', 'overwrite', 'empty-response') AND state <> 'Complete' THEN ['not complete'] ELSE [] END,
            CASE WHEN scenario = 'success' AND (NOT "exists" OR NOT has_header) THEN ['no valid output'] ELSE [] END,
            CASE WHEN scenario IN ('cancellation', 'skip', 'collision-cancel', 'write-failure', 'recognizer-failure', 'mixed-failure')
                 AND NOT preseeded THEN ['no sentinel'] ELSE [] END,
            CASE WHEN scenario IN ('cancellation', 'skip', 'collision-cancel', 'write-failure', 'recognizer-failure')
                 AND preseeded AND NOT preserved THEN ['sentinel changed'] ELSE [] END,
            CASE WHEN scenario = 'skip' AND NOT skipped THEN ['not skipped'] ELSE [] END,
            CASE WHEN scenario = 'collision-cancel' AND state <> 'Cancelled' THEN ['not cancelled'] ELSE [] END,
            CASE WHEN scenario = 'overwrite' AND (NOT preseeded OR preserved) THEN ['not replaced'] ELSE [] END,
            CASE WHEN scenario IN ('write-failure', 'write-denied') AND state <> 'Failed' THEN ['not failed'] ELSE [] END,
            CASE WHEN scenario = 'write-denied' AND "exists" THEN ['output left'] ELSE [] END,
            CASE WHEN scenario = 'empty-response' AND cue_count <> 0 THEN ['has cues'] ELSE [] END,
            CASE WHEN scenario = 'empty-response' AND (NOT "exists" OR NOT header_only) THEN ['not header only'] ELSE [] END,
            CASE WHEN scenario = 'mixed-failure' AND state = 'Cancelled' THEN ['state'] ELSE [] END,
            CASE WHEN scenario = 'mixed-failure' AND state = 'Failed' AND preseeded AND NOT preserved
                 THEN ['failed job changed its output'] ELSE [] END,
            CASE WHEN scenario = 'mixed-failure' AND state = 'Complete' AND preseeded AND preserved
                 THEN ['complete job left its sentinel'] ELSE [] END,
            CASE WHEN scenario = 'mixed-failure' AND state = 'Complete' AND NOT ("exists" AND has_header)
                 THEN ['complete job without valid output'] ELSE [] END)) AS rule
        FROM job_rows""",
    "fix": """
        SELECT file_id, max(e) AS top, count(*) AS n, max(e) + (file_id % 5) * 10000 AS total,
               (file_id % 5) * 10000 + CASE WHEN file_id % 9 = 0 THEN 1 ELSE 0 END AS tail_gap,
               printf('rec-%08d', file_id) AS name
        FROM utt GROUP BY file_id""",
    "man": f"""
        SELECT file_id, idx, s - CASE WHEN (file_id + idx) % 14 = 5 THEN 9000 ELSE 0 END AS s, e, s AS true_s,
               lag(e) OVER (PARTITION BY file_id ORDER BY idx) AS pe,
               CASE WHEN idx = 0 THEN 0 ELSE 8000 END AS gap
        FROM utt""",
}

# View -> the views it is built on.
_USES = {
    "marks": ["frames"], "runs": ["marks"], "latched": ["runs"], "rises": ["latched"], "islands": ["rises"],
    "pieces": ["islands"], "det0": ["utt"], "det": ["det0"], "matched": ["utt", "det"], "shared": ["utt", "det"],
    "rough": ["utt"], "numbered": ["rough"], "clamped": ["numbered"], "resp": ["resp0"], "rec": ["listing"],
    "work": ["rec"], "reached": ["jobs"], "now": ["jobs"], "evidence": ["run_a", "run_b"],
    "job_rows": ["evidence", "scenarios"], "broken_jobs": ["job_rows"], "fix": ["utt"], "man": ["utt"],
}


def _with(body: str, *names: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        for other in _USES.get(name, []):
            visit(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    recursive = "RECURSIVE " if "clamped" in needed else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + " " + body


def _normal(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '\\pP', '', 'g'), '{_W}+', ' ', 'g'))"


def _stamp(ms: str) -> str:
    return f"printf('%02d:%02d:%02d.%03d', ({ms}) // 3600000, (({ms}) // 60000) % 60, (({ms}) // 1000) % 60, ({ms}) % 1000)"


def _words(text: str) -> str:
    return f"len(list_filter(string_split({_normal(text)}, ' '), lambda w: w <> ''))"


def _scan(o: DetectorOptions) -> str:
    """The detector frame by frame: one recursion step per frame, at most one cut in each."""
    t = o.segmenter
    return f"""
        WITH RECURSIVE f AS (SELECT file_id, frame_idx AS i, frame_idx * 320 AS s, (frame_idx + 1) * 320 AS e, dbfs AS l FROM ({VIEWS["frames"]})),
        scan AS (
          SELECT file_id, -1::BIGINT AS i, {o.initial_floor}::DOUBLE AS nf, 0 AS ar, 0 AS br, 0::BIGINT AS onset, false AS speech,
                 0::BIGINT AS core, 0::BIGINT AS o, 0::BIGINT AS v, false AS follows, []::STRUCT(s BIGINT, l DOUBLE)[] AS c,
                 0::BIGINT AS island, false AS cut, 0::BIGINT AS cs, 0::BIGINT AS ce, false AS closed, 0::BIGINT AS ks, 0::BIGINT AS ke,
                 false AS tail, 0::BIGINT AS e
          FROM (SELECT DISTINCT file_id FROM f)
          UNION ALL
          SELECT file_id, i,
                 CASE WHEN b AND (NOT speech OR closes) THEN
                   least(greatest(nf + {o.adaptation}::DOUBLE * (CASE WHEN isinf(l) THEN {o.min_floor}::DOUBLE ELSE l END - nf), {o.min_floor}::DOUBLE), {o.max_floor}::DOUBLE)
                   ELSE nf END,
                 ar, br, onset, speech AND NOT closes, core, o, v, follows, CASE WHEN closes THEN [] ELSE c END, island, cut, cs, ce,
                 closes AND least(e, v + {t.post_roll}, o + {t.max_segment}) > o AND (follows OR v - core >= {t.min_speech}),
                 o, least(e, v + {t.post_roll}, o + {t.max_segment}), follows, e
          FROM (
            SELECT * REPLACE (CASE WHEN cut THEN ce ELSE core END AS core, CASE WHEN cut THEN ce ELSE o END AS o,
                              follows OR cut AS follows, CASE WHEN cut THEN [] ELSE c END AS c),
                   was AND br >= {t.silence_frames} AS closes
            FROM (
              SELECT *, speech AND least(e, v + {t.post_roll}) > o + {t.max_segment} AS cut, o AS cs,
                     list_reduce(list_prepend({{'s': o + {t.max_segment}, 'l': 'infinity'::DOUBLE}}, list_filter(c, lambda x: x.s > o
                       AND x.s <= o + {t.max_segment} AND x.s >= greatest(0, o + {t.max_segment} - {t.split_search}))),
                       lambda x, y: CASE WHEN y.l <= x.l THEN y ELSE x END).s AS ce
              FROM (
                SELECT file_id, i, s, e, l, a, b, nf, ar, br, onset, speech AS was, speech OR ar >= {t.onset_frames} AS speech,
                       CASE WHEN opens THEN onset ELSE core END AS core,
                       CASE WHEN opens THEN greatest(0, onset - {t.pre_roll}) ELSE o END AS o,
                       CASE WHEN opens OR (speech AND NOT b) THEN e ELSE v END AS v, NOT opens AND follows AS follows,
                       CASE WHEN opens THEN onset ELSE island END AS island,
                       list_filter(c, lambda x: x.s >= s - {t.split_search}) AS c
                FROM (
                  SELECT *, NOT speech AND ar >= {t.onset_frames} AS opens FROM (
                    SELECT * REPLACE (CASE WHEN a THEN ar + 1 ELSE 0 END AS ar, CASE WHEN b THEN br + 1 ELSE 0 END AS br,
                                      CASE WHEN NOT speech AND a AND ar = 0 THEN s ELSE onset END AS onset,
                                      CASE WHEN speech OR (a AND ar > 0) THEN list_append(c, {{'s': s, 'l': l}})
                                           WHEN a THEN [{{'s': s, 'l': l}}] ELSE [] END AS c)
                    FROM (
                      SELECT f.file_id, f.i, f.s, f.e, f.l, nf, ar, br, onset, speech, core, o, v, follows, c, island,
                             f.l >= greatest({o.min_on}::DOUBLE, nf + {o.on_margin}::DOUBLE) AS a,
                             f.l < greatest({o.min_off}::DOUBLE, nf + {o.off_margin}::DOUBLE) AS b
                      FROM scan JOIN f ON f.file_id = scan.file_id AND f.i = scan.i + 1))))))),
        ends AS (SELECT * FROM scan QUALIFY i = max(i) OVER (PARTITION BY file_id)),
        found AS (
          SELECT file_id, i * 2 AS pos, island, cs AS s, ce AS e, 'forced' AS kind FROM scan WHERE cut
          UNION ALL SELECT file_id, i * 2 + 1, island, ks, ke, CASE WHEN tail THEN 'tail' ELSE 'natural' END FROM scan WHERE closed
          UNION ALL SELECT file_id, i * 2 + 1, island, o, least(e, v + {t.post_roll}, o + {t.max_segment}), CASE WHEN follows THEN 'tail' ELSE 'natural' END
          FROM ends WHERE speech AND least(e, v + {t.post_roll}, o + {t.max_segment}) > o AND (follows OR v - core >= {t.min_speech})),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id, island ORDER BY pos) - 1 AS k FROM found),
        folded AS (
          SELECT file_id, list_reduce(list([{{'s': s, 'e': e, 'kind': kind}}] ORDER BY pos), lambda x, y:
            CASE WHEN y[1].kind = 'natural' AND y[1].s <= x[-1].e + {t.merge_gap}
                      AND greatest(x[-1].e, y[1].e) - x[-1].s <= {t.max_segment}
                 THEN list_append(x[1:len(x) - 1], {{'s': x[-1].s, 'e': greatest(x[-1].e, y[1].e), 'kind': x[-1].kind}})
                 WHEN y[1].e > greatest(y[1].s, x[-1].e)
                 THEN list_append(x, {{'s': greatest(y[1].s, x[-1].e), 'e': y[1].e, 'kind': y[1].kind}})
                 ELSE x END) AS p
          FROM found GROUP BY file_id)"""


_MERGED = " SELECT file_id, p.s AS start_sample, p.e AS end_sample FROM (SELECT file_id, unnest(p) AS p FROM folded)"

_STAMP_RE = "^[0-9]{2,}:[0-5][0-9]:[0-5][0-9]\\.[0-9]{3}$"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["list_recordings"] = _with("SELECT doc_id, relative_path, length FROM rec", "rec")
    sql["content_hash"] = """
        SELECT doc_id, upper(sha256(text)) AS sha,
               upper(sha256(encode(text)[3:greatest(octet_length(encode(text)) - 5, 0) + 2])) AS data_sha FROM documents"""
    sql["output_paths"] = _with(
        "SELECT doc_id, relative_path AS relative, vtt AS output, 2 AS depth FROM listing", "listing"
    )
    sql["escaping_paths"] = _with(
        """SELECT doc_id, ['', '../', 'a/../../', './', '/', '..\\', 'a/../'][doc_id % 7 + 1] || relative_path AS relative_path,
                  doc_id % 7 IN (1, 2, 4, 5) AS escapes FROM listing""",
        "listing",
    )
    sql["windows_safe_paths"] = r"""
        WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '')
                          || ['', '/con', '/Aux.txt', '/com1.a.b', '/x.', '/lpt9'][page_id % 6 + 1] AS path FROM pages)
        SELECT page_id, page_id % 6 IN (0, 3) AND path NOT LIKE '%?%' AND length(path) <= 240 AS safe FROM p"""
    sql["interval_bounds"] = _with(
        """SELECT file_id, idx, s - 6000 >= 0 AND e > s AS valid, least(greatest(s - 6000, 0), 300000) AS clamped_start,
                  least(greatest(e - 6000, 0), 300000) AS clamped_end FROM det""",
        "det",
    )
    sql["timecodes"] = _with(
        f"""SELECT file_id, idx AS cue_idx, ms, {_stamp('ms')} AS shown, ms * 16 AS samples
            FROM (SELECT *, ((s * 97 + idx) * 1000 + 8000) // 16000 AS ms FROM utt)""",
        "utt",
    )
    sql["parse_timestamps"] = f"""
        WITH t AS (SELECT event_id, {_stamp('event_id * 3777')} AS g FROM events),
        k AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN substr(g, 2, 20) WHEN 1 THEN replace(g, '.', ',')
                   WHEN 2 THEN g || '0' WHEN 3 THEN regexp_replace(g, ':[0-9][0-9][.]', ':61.') ELSE g END AS text FROM t)
        SELECT event_id, text, CASE WHEN regexp_matches(text, '{_STAMP_RE}') THEN
               string_split(text, ':')[1]::BIGINT * 3600000 + string_split(text, ':')[2]::BIGINT * 60000
               + replace(string_split(text, ':')[3], '.', '')::BIGINT END AS ms FROM k"""
    sql["sanitized_text"] = f"""
        SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN ''
               ELSE trim(regexp_replace(nfc_normalize(replace(text, '.', ' → ') || 'é'), '{_W}+', ' ', 'g')) END AS text FROM documents"""
    sql["normalized_text"] = f"""
        SELECT doc_id, {_normal("text || E'\\r\\n +$ — « Q»'")} AS text FROM documents"""
    sql["tokens"] = f"""
        WITH t AS (SELECT page_id, list_filter(string_split({_normal('html')}, ' '), lambda w: w <> '') AS t FROM pages)
        SELECT page_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM t"""
    sql["compact_messages"] = f"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_W}+', ' ', 'g')) AS m FROM documents)
        SELECT doc_id, CASE WHEN length(m) > 180 THEN substr(m, 1, 179) || '…' ELSE m END AS message FROM t"""
    sql["vtt_headers"] = f"""
        WITH t AS (SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id % 3 = 0 THEN E'\\n' ELSE text END AS body FROM documents)
        SELECT doc_id, k IN (0, 1, 2) AS prefix,
               k = 1 OR (k = 0 AND (body = '' OR regexp_matches(body, '^{_W}'))) AS strict,
               k IN (0, 1) AND NOT regexp_matches(body, '[^\\pZ\\t-\\r\\x{{85}}]') AS header_only FROM t"""
    sql["strict_utf8"] = """
        SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text,
               CASE WHEN doc_id % 7 = 0 THEN 'content is not valid UTF-8' END AS error FROM documents"""
    sql["sha256_shapes"] = "SELECT doc_id, doc_id % 4 IN (0, 3) AS ok FROM documents"
    sql["safe_percentages"] = """
        SELECT source, lang, CASE WHEN count(quality) = 0 THEN 0.0 ELSE sum(quality) * 100.0::DOUBLE / count(quality) END AS percent
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang"""
    sql["normalized_progress"] = _with("SELECT seq, progress FROM jobs", "jobs")
    sql["durations_shown"] = """
        WITH t AS (SELECT event_id, greatest(floor((value - 5) * 60), 0)::BIGINT AS n FROM events)
        SELECT event_id, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, (n // 60) % 60, n % 60)
               ELSE printf('%d:%02d', n // 60, n % 60) END AS shown FROM t"""
    sql["stage_progress"] = _with(
        """SELECT seq, round(CASE stage WHEN 'ExtractingAudio' THEN 0.3 * progress WHEN 'DetectingSpeech' THEN 0.3 + 0.15 * progress
                  WHEN 'Transcribing' THEN 0.45 + 0.5 * progress WHEN 'WritingVtt' THEN 0.95 + 0.05 * progress END, 9) AS progress FROM jobs""",
        "jobs",
    )
    sql["transcribe_progress"] = _with(
        """SELECT file_id, idx, round(0.45::DOUBLE + 0.5::DOUBLE * (d - (e - s)) / t, 9) AS progress_before,
                  round(0.45::DOUBLE + 0.5::DOUBLE * d / t, 9) AS progress_after
           FROM (SELECT *, sum(e - s) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS d,
                        sum(e - s) OVER (PARTITION BY file_id) AS t FROM utt)""",
        "utt",
    )

    sql["frame_energy"] = _with(
        """SELECT file_id, i // 4 AS frame_idx, min(i) AS start_sample, max(i) + 1 AS end_sample, round(sqrt(avg(s * s)), 6) AS rms,
                  CASE WHEN sum(s * s) > 0 THEN round(20 * log10(sqrt(avg(s * s)) / 32768), 6) ELSE '-infinity'::DOUBLE END AS dbfs
           FROM (SELECT file_id, frame_idx AS i, round((value - 35) * 60)::BIGINT AS s FROM frames) GROUP BY file_id, i // 4""",
        "frames",
    )
    waves = """
        WITH d AS (SELECT doc_id, text, octet_length(encode(text)) // 2 * 2 AS n,
                          CASE WHEN doc_id % 13 = 1 THEN 'declared size exceeds the file' WHEN doc_id % 7 = 3 THEN 'not PCM'
                               WHEN doc_id % 11 = 5 THEN 'not 16 kHz mono 16-bit' END AS error FROM documents)"""
    sql["wave_layouts"] = waves + """
        SELECT doc_id::VARCHAR AS path, CASE WHEN error IS NULL THEN 16000 END AS sample_rate, CASE WHEN error IS NULL THEN 44 END AS data_offset,
               CASE WHEN error IS NULL THEN n END AS data_length, CASE WHEN error IS NULL THEN n // 2 END AS sample_count, error FROM d
        UNION ALL SELECT 'gone-' || unnest([0, 1]), NULL, NULL, NULL, NULL, 'the recording is missing'"""
    sql["pcm_hashes"] = waves + """
        SELECT doc_id::VARCHAR AS path, upper(sha256(unhex(substr(hex(encode(text)), 1, 2 * n)))) AS pcm_sha FROM d WHERE error IS NULL"""
    sql["quarantined_recordings"] = waves + " SELECT error, count(*) AS files FROM d WHERE error IS NOT NULL GROUP BY error"
    sql["wave_frames"] = waves + """,
        h AS (SELECT doc_id, hex(encode(text)) AS x, unnest(range(n // 2)) AS i FROM d WHERE error IS NULL),
        v AS (SELECT doc_id, i, ('0x' || substr(x, i * 4 + 3, 2) || substr(x, i * 4 + 1, 2))::INT AS u FROM h),
        s AS (SELECT doc_id, i, (CASE WHEN u >= 32768 THEN u - 65536 ELSE u END)::BIGINT AS s FROM v)
        SELECT doc_id::VARCHAR AS file_id, i // 320 AS frame_idx, min(i) AS start_sample, max(i) + 1 AS end_sample, round(sqrt(avg(s * s)), 4) AS rms
        FROM s GROUP BY doc_id, i // 320"""
    tones = """
        WITH d AS (SELECT item_id, length(text) * 320 + 8000 AS n, item_id || '.wav' AS name, item_id % 5 = 0 AS there,
                          CASE WHEN item_id % 7 = 3 THEN 'not a RIFF file' WHEN item_id % 11 = 4 THEN 'declared size exceeds the file'
                               WHEN 2 * (length(text) * 320 + 8000 + 6400) % 13 = 5 THEN 'cannot recognise' END AS error FROM benchmark)"""
    sql["bulk_transcription"] = tones + f"""
        SELECT '/out/' || item_id || '.vtt' AS output_path, 0 AS part_no, E'WEBVTT\\n\\n' || {_stamp('200')} || ' --> ' || {_stamp('(9600 + n) // 16')}
               || E'\\nheard ' || (n + 6400) || E' samples\\n\\n' AS text, 1 AS cue_count FROM d WHERE error IS NULL AND NOT there"""
    sql["bulk_jobs"] = tones + """,
        w AS (SELECT name, item_id::VARCHAR AS stem, there, error FROM d UNION ALL SELECT 'gone.wav', 'gone', false, 'the recording is missing')
        SELECT name AS relative_path, '/out/' || stem || '.vtt' AS output_path, 'skip' AS policy,
               CASE WHEN there OR error IS NULL THEN 'Complete' ELSE 'Failed' END AS state,
               CASE WHEN there THEN 'Existing VTT skipped' ELSE coalesce(error, 'Complete') END AS detail,
               CASE WHEN there OR error IS NOT NULL THEN 0 ELSE 1 END AS cue_count FROM w
        UNION ALL SELECT name, '/out/' || stem || '.vtt', 'cancel', 'Cancelled', 'Cancelled before start', 0 FROM w"""
    sql["sink_dispositions"] = """
        WITH d AS (SELECT doc_id, lang || '/' || doc_id || '.vtt' AS p, replace(coalesce(text, ''), chr(10), '') AS t, coalesce(text, '') AS text FROM documents)
        SELECT 1 AS run, p AS output_path, 'Written' AS disposition FROM d WHERE doc_id % 3 = 0
        UNION ALL SELECT 2, p, CASE WHEN doc_id % 10 = 7 THEN 'Conflict' WHEN doc_id % 3 = 0 THEN 'SkippedExisting' ELSE 'Written' END FROM d
        UNION ALL SELECT 3, p, 'Written' FROM d WHERE doc_id % 4 = 0
        UNION ALL SELECT 0, p, sha256(CASE WHEN doc_id % 4 = 0 THEN replace(t, 'e', 'E') ELSE t END) FROM d
                  WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 10 <> 7"""
    sql["classified_frames"] = _with("SELECT file_id, frame_idx, above, below FROM marks", "marks")
    sql["frame_violations"] = _with(
        """SELECT file_id, frame_idx, rule FROM (
             SELECT file_id, frame_idx, CASE WHEN a % 41 = 0 THEN 'empty'
                    WHEN CASE WHEN frame_idx = 0 THEN 0 ELSE frame_idx * 320 - CASE WHEN (a - 1) % 41 = 0 THEN 320 ELSE 0 END END
                         <> frame_idx * 320 + CASE WHEN a % 37 = 0 THEN 10 ELSE 0 END THEN 'contiguity'
                    WHEN a % 43 = 0 THEN 'level' END AS rule
             FROM (SELECT *, frame_idx + file_id AS a FROM frames)) WHERE rule IS NOT NULL""",
        "frames",
    )
    sql["latch_states"] = _with("SELECT file_id, frame_idx, st = 1 AS in_speech FROM latched", "latched")
    sql["speech_islands"] = _with("SELECT file_id, core_start, voiced_end, close_sample, closed FROM islands", "islands")
    sql["padded_pieces"] = _with("SELECT file_id, s AS start_sample, e AS end_sample FROM pieces", "pieces")
    sql["detect_fixed"] = _with(
        """SELECT file_id, min(s) AS start_sample, max(e) AS end_sample FROM (
             SELECT *, sum(CASE WHEN s <= pe + 320 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY island) AS chain
             FROM (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
                   FROM pieces)) GROUP BY file_id, chain""",
        "pieces",
    )

    sql["interval_violations"] = _with(
        """SELECT file_id, idx, rule FROM (
             SELECT file_id, idx, CASE WHEN s2 < 0 OR e2 <= s2 OR e2 > t THEN 'bounds'
                    WHEN s2 < lag(e2) OVER (PARTITION BY file_id ORDER BY idx) THEN 'order' END AS rule
             FROM (SELECT *, s - CASE WHEN (file_id + idx) % 9 = 0 THEN 9000 ELSE 0 END AS s2,
                          e + CASE WHEN (file_id + idx) % 10 = 0 THEN 500000 ELSE 0 END AS e2,
                          max(e) OVER (PARTITION BY file_id) AS t FROM utt)) WHERE rule IS NOT NULL""",
        "utt",
    )
    sql["overlap_pairs"] = _with(
        """SELECT u.file_id, u.idx AS a_idx, d.idx AS b_idx FROM utt u
           JOIN det d ON d.file_id = u.file_id AND u.s < d.e AND u.e > d.s""",
        "utt", "det",
    )
    sql["best_matches"] = _with(
        """SELECT file_id, idx, s AS start_sample, e AS end_sample, ds AS detected_start, de AS detected_end,
                  coalesce(ov, 0) AS overlap_samples, sh AS shared_samples, ds - s AS start_error, de - e AS end_error,
                  abs(ds - s) AS abs_start_error, abs(de - e) AS abs_end_error,
                  coalesce(abs(ds - s) <= 1600 AND abs(de - e) <= 1600, false) AS within_tolerance FROM matched""",
        "matched",
    )
    sql["boundary_errors"] = _with(
        """SELECT file_id, quantile_cont(abs(ds - s), 0.5)::DOUBLE AS median_start, quantile_cont(abs(de - e), 0.5)::DOUBLE AS median_end,
                  min(ds - s) AS earliest, max(de - e) AS latest FROM matched WHERE ds IS NOT NULL GROUP BY file_id""",
        "matched",
    )
    sql["produced_without_overlap"] = _with(
        """SELECT file_id, idx FROM det d WHERE NOT EXISTS (SELECT 1 FROM utt u WHERE u.file_id = d.file_id
             AND (u.file_id + u.idx) % 3 = 0 AND u.s < d.e AND u.e > d.s)""",
        "utt", "det",
    )
    sql["expected_without_overlap"] = _with(
        "SELECT file_id, idx FROM utt u WHERE NOT EXISTS (SELECT 1 FROM det d WHERE u.file_id = d.file_id AND u.s < d.e AND u.e > d.s)",
        "utt", "det",
    )
    sql["total_speech"] = _with("SELECT file_id, sum(e - s)::BIGINT AS total_samples FROM det GROUP BY file_id", "det")
    sql["true_positive_samples"] = _with("SELECT file_id, n AS overlap_samples FROM shared", "shared")

    per_file = """
        m AS (SELECT file_id, count(*) AS ec, count(ds) AS mc, sum(e - s) AS es,
                     count(*) FILTER (abs(ds - s) <= 1600 AND abs(de - e) <= 1600) AS wc,
                     list(abs(ds - s)) FILTER (ds IS NOT NULL) AS se, list(abs(de - e)) FILTER (ds IS NOT NULL) AS ee
              FROM matched GROUP BY file_id),
        d AS (SELECT file_id, count(*) AS dc, sum(e - s) AS dl, count(*) FILTER (e - s = 40000) AS ac FROM det GROUP BY file_id),
        f AS (SELECT m.file_id, ec, mc, coalesce(dc, 0) AS dc, coalesce(ac, 0) AS ac, es, coalesce(dl, 0) AS dl, coalesce(n, 0) AS tp, wc, se, ee
              FROM m LEFT JOIN d USING (file_id) LEFT JOIN shared USING (file_id)),
        g AS (SELECT file_id, ec, mc, dc, ac, es, dl, tp, wc, se, ee FROM f UNION ALL
              SELECT NULL, sum(ec), sum(mc), sum(dc), sum(ac), sum(es), sum(dl), sum(tp), sum(wc), flatten(list(se)), flatten(list(ee)) FROM f)"""
    columns = """
        ec::BIGINT AS expected_count, mc::BIGINT AS matched_count, dc::BIGINT AS detected_count, ac::BIGINT AS at_max_count,
        es::BIGINT AS expected_samples, dl::BIGINT AS detected_samples, tp::BIGINT AS true_positive_samples,
        wc::BIGINT AS within_tolerance_count, list_aggregate(se, 'quantile_cont', 0.5)::DOUBLE AS median_abs_start_error,
        list_aggregate(ee, 'quantile_cont', 0.5)::DOUBLE AS median_abs_end_error, (ec - mc)::BIGINT AS unmatched_count,
        (es - tp)::BIGINT AS missed_samples, (dl - tp)::BIGINT AS false_positive_samples,
        CASE WHEN es = 0 THEN 0 ELSE (es - tp) * 100.0::DOUBLE / es END AS missed_percent,
        CASE WHEN dl = 0 THEN 0 ELSE (dl - tp) * 100.0::DOUBLE / dl END AS false_positive_percent_of_detected,
        CASE WHEN es = 0 THEN 0 ELSE (dl - tp) * 100.0::DOUBLE / es END AS false_positive_percent_of_expected,
        CASE WHEN ec = 0 THEN 0 ELSE mc * 100.0::DOUBLE / ec END AS recall_percent"""
    metrics = _with("", "matched", "shared").rstrip() + ", " + per_file
    sql["detection_metrics"] = f"{metrics} SELECT file_id, {columns} FROM g"
    sql["detection_corpus"] = f"{metrics} SELECT {columns} FROM g WHERE file_id IS NULL"
    sql["sequence_equality"] = _with(
        """SELECT file_id, bool_and((file_id + idx) % 6 <> 0) AS equal, count(*) AS a_count, count(*) AS b_count FROM utt GROUP BY file_id""",
        "utt",
    )
    sql["interval_chunks"] = _with(
        """SELECT file_id, idx, k AS chunk_idx, s + k * 1600 AS chunk_start, least(s + (k + 1) * 1600, e) AS chunk_end
           FROM (SELECT *, unnest(range((e - s + 1599) // 1600)) AS k FROM utt)""",
        "utt",
    )

    sql["timeline"] = _with("SELECT file_id, idx, s AS start_sample, e AS end_sample FROM utt", "utt")
    sql["clamped_cues"] = _with("SELECT file_id, cue_no, start_ms, end_ms, text FROM clamped", "clamped")
    sql["vtt_documents"] = _with(
        f"""SELECT i.file_id, 0 AS part_no, E'WEBVTT\\n\\n' || coalesce(string_agg({_stamp('start_ms')} || ' --> ' || {_stamp('end_ms')}
                   || E'\\n' || text || E'\\n\\n', '' ORDER BY cue_no), '') AS text, count(cue_no) AS cue_count
            FROM (SELECT DISTINCT file_id FROM utt) i LEFT JOIN (SELECT * FROM clamped WHERE file_id % 6 <> 1) c USING (file_id)
            GROUP BY i.file_id""",
        "clamped",
    )
    sql["vtt_round_trip"] = _with(
        "SELECT file_id, cue_no, start_ms, end_ms, text, NULL::VARCHAR AS error FROM clamped", "clamped"
    )
    sql["vtt_errors"] = _with(
        """SELECT DISTINCT file_id, ['no WEBVTT header', 'no timing line', 'empty text', 'regressing cue'][file_id % 5 + 1] AS error
           FROM clamped WHERE file_id % 5 < 4""",
        "clamped",
    )
    sql["regressing_cues"] = _with(
        """SELECT file_id, cue_idx + 1 AS cue_no, s AS start_ms, pe AS previous_end_ms
           FROM (SELECT *, lag(e) OVER (PARTITION BY file_id ORDER BY cue_idx) AS pe FROM rough) WHERE s < pe""",
        "rough",
    )
    sql["cue_agreement"] = _with(
        f"""SELECT file_id, idx, rule FROM (
              SELECT coalesce(u.file_id, c.file_id) AS file_id, coalesce(u.idx, c.cue_no - 1) AS idx,
                     CASE WHEN u.idx IS NULL THEN 'extra cue' WHEN c.cue_no IS NULL THEN 'missing cue'
                          WHEN (u.s * 1000 + 8000) // 16000 <> start_ms OR (u.e * 1000 + 8000) // 16000 <> end_ms THEN 'timing'
                          WHEN {_normal('u.text')} <> {_normal('c.text')} THEN 'text' END AS rule
              FROM utt u FULL JOIN clamped c ON c.file_id = u.file_id AND c.cue_no - 1 = u.idx) WHERE rule IS NOT NULL""",
        "clamped",
    )
    # A kept fifth word is replaced by one that occurs nowhere else, a lost word shortens the text: each costs one edit,
    # and words at both kinds of place (every thirty-fifth) are lost.
    sql["word_edits"] = f"""
        WITH t AS (SELECT doc_id, {_words('text')} AS n FROM documents)
        SELECT doc_id, n AS words, n // 7 + n // 5 - n // 35 AS edits FROM t"""
    diagnostics = f"""
        w AS (SELECT file_id, sum({_words('text')}) AS ew FROM utt GROUP BY file_id),
        a AS (SELECT file_id, sum({_words('text')}) AS aw FROM det GROUP BY file_id),
        p AS (SELECT file_id, count(*) AS n FROM det d WHERE NOT EXISTS
              (SELECT 1 FROM utt u WHERE u.file_id = d.file_id AND u.s < d.e AND u.e > d.s) GROUP BY file_id),
        q AS (SELECT file_id, count(*) AS n FROM utt u WHERE NOT EXISTS
              (SELECT 1 FROM det d WHERE u.file_id = d.file_id AND u.s < d.e AND u.e > d.s) GROUP BY file_id),
        r AS (SELECT file_id, ew::BIGINT AS expected_words, coalesce(aw, 0)::BIGINT AS actual_words, (ew - coalesce(aw, 0))::BIGINT AS word_edits,
                     CASE WHEN ew = 0 THEN 0 ELSE (ew - coalesce(aw, 0)) * 100.0::DOUBLE / ew END AS word_edit_percent,
                     coalesce(p.n, 0) AS produced_without_overlap, coalesce(q.n, 0) AS expected_without_overlap
              FROM w LEFT JOIN a USING (file_id) LEFT JOIN p USING (file_id) LEFT JOIN q USING (file_id))"""
    diagnosed = _with("", "utt", "det").rstrip() + ", " + diagnostics
    sql["transcript_diagnostics"] = f"{diagnosed} SELECT * FROM r"
    good = lambda value: f"CASE WHEN file_id % 5 <> 0 THEN {value} END"
    sql["document_diagnostics"] = _with(
        f"""SELECT file_id, {good("n")} AS expected_words, {good("n")} AS actual_words, {good("0")} AS word_edits, {good("0.0::DOUBLE")} AS word_edit_percent,
            {good("0")} AS produced_without_overlap, {good("0")} AS expected_without_overlap,
            CASE WHEN file_id % 5 = 0 THEN 'no WEBVTT header' END AS error
            FROM (SELECT file_id, sum({_words('text')})::BIGINT AS n FROM utt GROUP BY file_id)""",
        "utt",
    )
    sql["evaluate_files"] = _with(
        f""", f AS (
              SELECT file_id, sum({_words('text')})::BIGINT AS n, count(*) FILTER (file_id % 4 = 1 AND idx % 2 = 0) AS d,
                     CASE WHEN file_id % 7 = 2 THEN 'the document is missing' WHEN file_id % 5 = 0 THEN 'no WEBVTT header' END AS error
              FROM utt GROUP BY file_id),
            g AS (SELECT *, d * 100.0::DOUBLE / n AS p FROM f WHERE error IS NULL)
            SELECT 'recording' AS part, file_id, NULL::BIGINT AS idx, error AS note, CASE WHEN error IS NULL THEN n END AS expected_words,
                   CASE WHEN error IS NULL THEN n + d END AS actual_words, CASE WHEN error IS NULL THEN d END AS word_edits,
                   CASE WHEN error IS NULL THEN d * 100.0::DOUBLE / n END AS word_edit_percent FROM f
            UNION ALL SELECT 'cue', u.file_id, u.idx, 'text', NULL, NULL, NULL, NULL FROM utt u JOIN g USING (file_id)
                      WHERE u.file_id % 4 = 1 AND u.idx % 2 = 0
            UNION ALL SELECT 'corpus', (list(file_id ORDER BY p DESC, file_id))[1], count(*), NULL, sum(n)::BIGINT, sum(n + d)::BIGINT, sum(d)::BIGINT,
                      sum(d) * 100.0::DOUBLE / sum(n) FROM g""",
        "utt",
    )
    sql["nested_reports"] = _with(
        """SELECT file_id, idx // 3 AS part_no, any_value(n) AS utterances, any_value(r) AS recordings, any_value(t) AS corpus_utterances,
                  string_agg(idx || ':' || text, '|' ORDER BY idx) AS texts
           FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM utt), (SELECT count(DISTINCT file_id) AS r, count(*) AS t FROM utt)
           GROUP BY file_id, idx // 3""",
        "utt",
    )
    sql["transcript_rollup"] = f"""{diagnosed}
        SELECT count(*) AS recordings, sum(expected_words)::BIGINT AS expected_words, sum(actual_words)::BIGINT AS actual_words,
               sum(word_edits)::BIGINT AS word_edits, sum(produced_without_overlap)::BIGINT AS produced_without_overlap,
               sum(expected_without_overlap)::BIGINT AS expected_without_overlap,
               sum(word_edits) * 100.0::DOUBLE / sum(expected_words) AS word_edit_percent,
               (list(file_id ORDER BY word_edit_percent DESC, file_id))[1] AS worst_file_id,
               (list(word_edits ORDER BY word_edit_percent DESC, file_id))[1] AS worst_word_edits,
               (list(word_edit_percent ORDER BY word_edit_percent DESC, file_id))[1] AS worst_percent FROM r"""
    sql["worst_recording"] = f"""{diagnosed}
        SELECT file_id, word_edits, word_edit_percent FROM r ORDER BY word_edit_percent DESC, file_id LIMIT 1"""
    sql["accumulated_transcripts"] = _with(
        """SELECT session_id, list_reduce(list(text ORDER BY seq), lambda x, y:
                  CASE WHEN starts_with(x, y) THEN x WHEN starts_with(y, x) THEN y ELSE x || y END) AS transcript
           FROM resp WHERE trim(text) <> '' GROUP BY session_id""",
        "resp",
    )
    sql["emission_gaps"] = _with(
        """SELECT session_id, seq, position FROM (SELECT session_id, seq,
                  row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS position
           FROM resp WHERE (session_id + seq) % 5 <> 3) WHERE position <> seq""",
        "resp",
    )
    sql["push_metrics"] = """
        SELECT user_id AS session_id, count(*) AS calls, bool_or(value > 80) AS any_wait, max(floor(value))::BIGINT AS max_ms,
               sum(floor(value))::BIGINT AS total_ms FROM events GROUP BY user_id"""

    out = "input_path, relative_path, output_path"
    sql["existing_outputs"] = _with(
        f"SELECT {out} FROM work WHERE lower(output_path) IN (SELECT lower(path) FROM outs WHERE NOT is_dir)", "work", "outs"
    )
    sql["conflicting_directories"] = _with(
        f"SELECT {out} FROM work WHERE lower(output_path) IN (SELECT lower(path) FROM outs WHERE is_dir)", "work", "outs"
    )
    sql["pending_skip"] = _with(
        f"SELECT {out} FROM work WHERE lower(output_path) NOT IN (SELECT lower(path) FROM outs WHERE NOT is_dir)", "work", "outs"
    )
    sql["pending_overwrite"] = _with(f"SELECT {out} FROM work", "work")
    sql["pending_cancel"] = _with(
        f"""SELECT {out} FROM work WHERE NOT EXISTS (SELECT 1 FROM work w JOIN outs o
            ON lower(w.output_path) = lower(o.path) AND NOT o.is_dir)""",
        "work", "outs",
    )
    sql["output_collisions"] = _with(
        """SELECT lower('/out/' || vtt) AS output_key, 2 AS inputs, path AS first_input FROM rec WHERE length(relative_path) % 2 = 0""",
        "rec",
    )
    sql["missing_listing"] = _with(
        """SELECT relative_path, output_path AS path FROM work WHERE lower(output_path) NOT IN (SELECT lower(path) FROM outs)""",
        "work", "outs",
    )
    sql["listing_differences"] = _with(
        """SELECT lower(path) AS key, 'unexpected' AS rule FROM outs WHERE lower(path) NOT IN (SELECT lower(output_path) FROM work)
           UNION ALL SELECT lower(output_path), 'missing' FROM work WHERE lower(output_path) NOT IN (SELECT lower(path) FROM outs)""",
        "work", "outs",
    )
    sql["stale_artifacts"] = """
        SELECT event_id, '/out/.voxtide-vtt.' || md5(event_id::VARCHAR) || '.tmp' AS path FROM events
        WHERE event_id % 3 <> 0 AND event_id % 4 <> 0 AND ts <= TIMESTAMP '2024-01-13 00:00:00'"""
    sql["discovery_summary"] = _with(
        """SELECT (SELECT count(*) FROM rec) AS files, count(*) AS issues,
                  count(*) || ' unreadable places, beginning with ''' || min(path) || ''': access denied' AS message,
                  false AS can_run FROM listing WHERE is_dir""",
        "rec",
    )

    sql["illegal_transitions"] = _with(
        """SELECT batch_id, job_id, seq, state, CASE WHEN r = 2 THEN 'after terminal' ELSE 'backwards' END AS rule
           FROM reached WHERE r = 2 OR (r = 1 AND state = 'Pending')""",
        "reached",
    )
    sql["current_jobs"] = _with("SELECT batch_id, job_id, state, last_seq, progress FROM now", "now")
    sql["cancelled_jobs"] = _with(
        """, j AS (SELECT * REPLACE (CASE WHEN state IN ('Complete', 'Failed') AND (seq + job_id) % 97 <> 0 THEN 'Transcribing' ELSE state END AS state) FROM jobs),
           n AS (SELECT batch_id, job_id, coalesce((list(state ORDER BY seq) FILTER (state IN ('Complete', 'Failed')))[1], 'open') AS st,
                        bool_or(state = 'Transcribing') AS active FROM j GROUP BY ALL)
           SELECT batch_id, job_id, CASE WHEN st <> 'open' THEN st
                  WHEN batch_id IN (SELECT batch_id FROM j WHERE value > 150) THEN 'Cancelled'
                  WHEN active THEN 'Transcribing' ELSE 'Pending' END AS state FROM n""",
        "jobs",
    )
    sql["batch_snapshots"] = _with(
        """SELECT batch_id, count(*) AS total, count(*) FILTER (state = 'Complete') AS complete, count(*) FILTER (state = 'Failed') AS failed,
                  0 AS cancelled, count(*) FILTER (state IN ('Complete', 'Failed')) AS finished,
                  CASE WHEN count(*) FILTER (state = 'Failed') > 0 THEN 'warning: failures' ELSE 'success' END AS message
           FROM now GROUP BY batch_id""",
        "now",
    )
    sql["first_stages"] = _with(
        """SELECT batch_id, job_id, min(seq) FILTER (stage = 'Transcribing') AS first_seq,
                  arg_min(ts, seq) FILTER (stage = 'Transcribing') AS first_ts FROM jobs GROUP BY ALL""",
        "jobs",
    )
    sql["monotone_progress"] = _with(
        """SELECT job_id, seq, coalesce(max(progress) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0)
                  AS shown_progress FROM jobs""",
        "jobs",
    )
    sql["stage_reports"] = _with(
        """SELECT job_id, seq, stage FROM (SELECT *, last_value(CASE WHEN forced THEN stage END IGNORE NULLS)
                  OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS f FROM jobs) WHERE NOT forced AND stage = f""",
        "jobs",
    )
    sql["rolling_durations"] = """
        WITH d AS (SELECT user_id % 8 AS batch_id, event_id AS seq, floor((value - 5) * 100)::BIGINT AS duration_ms,
                          user_id % 4 - 1 AS remaining FROM events),
        m AS (SELECT *, floor(avg(duration_ms) OVER (PARTITION BY batch_id ORDER BY seq ROWS 4 PRECEDING))::BIGINT AS mean_ms
              FROM d WHERE duration_ms > 0)
        SELECT batch_id, seq, duration_ms, remaining, mean_ms, mean_ms * greatest(remaining, 0) AS eta_ms FROM m"""
    sql["throttled_events"] = """
        WITH RECURSIVE e AS (SELECT user_id % 8 AS batch_id, event_id AS seq, epoch_us(ts) AS us, event_id % 11 = 0 AS forced,
                                    row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events),
        p AS (SELECT batch_id, seq, i, us AS published, true AS kept FROM e WHERE i = 1
              UNION ALL
              SELECT e.batch_id, e.seq, e.i, CASE WHEN e.forced OR e.us - p.published >= 600000000 THEN e.us ELSE p.published END,
                     e.forced OR e.us - p.published >= 600000000
              FROM p JOIN e ON e.batch_id = p.batch_id AND e.i = p.i + 1)
        SELECT batch_id, seq FROM p WHERE kept"""
    sql["latest_snapshots"] = _with(
        """SELECT job_id, max(seq) AS seq, arg_max(state, seq) AS state, arg_max(stage, seq) AS stage
           FROM jobs WHERE seq % 3 = 2 GROUP BY job_id""",
        "jobs",
    )

    sql["layout_pairs"] = _with(
        """SELECT *, flat_rows = 1 AND nested_rows = 1 AND file_sha_match AND pcm_sha_match AND sample_count_match AND intervals_match AS all_match
           FROM (SELECT file_id, 1 AS flat_rows, CASE WHEN file_id % 20 = 7 THEN 0 ELSE 1 END AS nested_rows,
                        file_id % 20 <> 7 AND file_id % 8 <> 3 AS file_sha_match, file_id % 20 <> 7 AS pcm_sha_match,
                        file_id % 20 <> 7 AS sample_count_match, file_id % 9 <> 4 AS intervals_match
                 FROM utt GROUP BY file_id)""",
        "utt",
    )
    sql["media_delta"] = _with(
        """SELECT layout, count(*) AS inputs, sum(file_id % 3 - 1)::BIGINT AS sample_delta, sum(k)::BIGINT AS intervals
           FROM (SELECT file_id, count(*) AS k FROM utt GROUP BY file_id), (VALUES ('flat'), ('nested')) v(layout)
           WHERE layout = 'flat' OR file_id % 20 <> 7 GROUP BY layout""",
        "utt",
    )
    sql["repeatability"] = _with(
        """SELECT a.relative_path, b.doc_id IS NOT NULL AS in_current, true AS in_baseline,
                  coalesce(a.text = b.text, false) AS byte_identical,
                  CASE WHEN b.doc_id IS NULL THEN 'no current output' WHEN NOT a.has_header THEN 'baseline without header'
                       WHEN a.text <> b.text THEN 'bytes differ' ELSE 'identical' END AS verdict
           FROM run_a a LEFT JOIN run_b b USING (doc_id)""",
        "run_a", "run_b",
    )
    parts = """, p AS (
             SELECT a.relative_path, b.doc_id IS NOT NULL AS c, coalesce(a.text = b.text, false) AS same,
                    unnest([string_split(a.relative_path, '/')[1] || '/' || string_split(a.relative_path, '/')[2], string_split(a.relative_path, '/')[1], '']) AS folder
             FROM run_a a LEFT JOIN run_b b USING (doc_id))"""
    sql["compare_runs"] = _with(
        parts + """
           SELECT 'folder' AS part, folder AS path, count(*) FILTER (c) AS files_current, count(*) AS files_baseline,
                  CASE WHEN bool_and(same) THEN 'same' ELSE 'differs' END AS verdict FROM p GROUP BY folder
           UNION ALL SELECT 'file', relative_path, c::BIGINT, 1,
                  CASE WHEN NOT c THEN 'no current output' WHEN NOT (SELECT has_header FROM run_a a WHERE a.relative_path = p.relative_path) THEN 'baseline without header'
                       ELSE 'bytes differ' END FROM p WHERE folder = '' AND NOT same""",
        "run_a", "run_b",
    )
    sql["compare_equal_runs"] = _with(
        parts + """
           SELECT folder, count(*) AS files_current, count(*) AS files_baseline, true AS same FROM p GROUP BY folder""",
        "run_a", "run_b",
    )
    sql["provenance"] = _with(
        """SELECT upper(b.relative_path) AS path,
                  CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 12 = 0 THEN 2 ELSE 1 END AS matches,
                  CASE WHEN doc_id % 11 = 0 THEN 'not in manifest' WHEN doc_id % 12 = 0 THEN 'ambiguous'
                       WHEN a.text <> b.text THEN 'hash differs' ELSE 'ok' END AS verdict
           FROM run_b b JOIN run_a a USING (doc_id)
           UNION ALL SELECT a.relative_path, CASE WHEN doc_id % 12 = 0 THEN 2 ELSE 1 END, 'no file'
           FROM run_a a ANTI JOIN run_b b USING (doc_id) WHERE doc_id % 11 <> 0""",
        "run_a", "run_b",
    )
    sql["output_evidence"] = _with(
        """SELECT relative_path, output_path, "exists", has_header, header_only, length, sha256, preseeded, preserved FROM evidence""",
        "evidence",
    )
    sql["snapshot_sync"] = _with(
        """, s AS (SELECT job_id, max(seq) AS q, arg_max(state, seq) AS state, arg_max(stage, seq) AS stage FROM jobs
                   WHERE seq % 100 < 60 AND job_id % 9 <> 0 GROUP BY job_id),
             t AS (SELECT job_id, max(seq) AS q, arg_max(state, seq) AS state, arg_max(stage, seq) AS stage FROM jobs
                   WHERE job_id % 10 <> 0 AND job_id % 7 < 6 GROUP BY job_id)
           SELECT 'job-' || coalesce(s.job_id, t.job_id) AS key,
                  CASE WHEN s.job_id IS NULL THEN 'insert' WHEN t.job_id IS NULL THEN 'delete'
                       WHEN s.state = t.state AND s.stage = t.stage THEN 'keep' ELSE 'update' END AS change,
                  t.job_id AS position, coalesce(t.state, s.state) AS state, coalesce(t.stage, s.stage) AS stage
           FROM s FULL JOIN t ON s.job_id = t.job_id""",
        "jobs",
    )
    sql["job_audit"] = _with("SELECT run_id, scenario, output_path, rule FROM broken_jobs", "broken_jobs")
    sql["run_audit"] = _with(
        """, b AS (SELECT run_id, count(*) AS n FROM broken_jobs GROUP BY run_id),
             j AS (SELECT source AS run_id, any_value(scenario) AS scenario, substr(source, 4)::INT AS k, count(*) AS jobs,
                          count(*) FILTER (state = 'Complete') AS complete, count(*) FILTER (state = 'Failed') AS failed,
                          count(*) FILTER (state = 'Cancelled') AS cancelled FROM job_rows GROUP BY source),
             v AS (SELECT *, scenario NOT IN ('cancellation') AND k % 5 = 0 AS c,
                          scenario IN ('success', 'skip', 'collision-cancel', 'overwrite', 'write-failure', 'write-denied',
                                       'empty-response', 'mixed-failure') AS closes FROM j),
             r AS (SELECT *, list_sort(list_concat(
                     CASE WHEN k = 13 THEN ['fatal error'] ELSE [] END,
                     CASE WHEN k = 12 THEN ['temporary files left'] ELSE [] END,
                     CASE WHEN c THEN ['cancelled'] ELSE [] END,
                     CASE WHEN closes AND k % 7 = 6 THEN ['jobs missing'] ELSE [] END,
                     CASE WHEN closes AND (k % 5 = 0) <> (scenario = 'collision-cancel') THEN ['not ended'] ELSE [] END,
                     CASE WHEN scenario = 'cancellation' AND k % 5 <> 0 THEN ['not cancelled'] ELSE [] END,
                     CASE WHEN scenario IN ('skip', 'collision-cancel', 'overwrite', 'write-failure') AND k % 3 = 0
                          THEN ['no preflight stage'] ELSE [] END,
                     CASE WHEN scenario IN ('skip', 'collision-cancel') AND k % 2 = 0 THEN ['model loaded'] ELSE [] END,
                     CASE WHEN scenario = 'write-denied' AND k % 4 = 0 THEN ['never wrote'] ELSE [] END,
                     CASE WHEN scenario IN ('recognizer-failure', 'mixed-failure') AND failed = 0 THEN ['no failed job'] ELSE [] END,
                     CASE WHEN scenario = 'mixed-failure' AND complete = 0 THEN ['no complete job'] ELSE [] END)) AS rv FROM v)
           SELECT r.run_id, scenario, jobs, complete, failed, cancelled, coalesce(n, 0) AS job_violations,
                  array_to_string(rv, '; ') AS run_violations, coalesce(n, 0) = 0 AND len(rv) = 0 AS passed
           FROM r LEFT JOIN b USING (run_id)""",
        "broken_jobs",
    )

    sql["manifest_header_rules"] = """
        SELECT o_orderkey AS manifest_id, unnest(list_concat(
            CASE WHEN o_orderkey % 5 NOT IN (2, 3) THEN ['version'] ELSE [] END,
            CASE WHEN o_orderkey % 6 = 0 THEN ['generator version'] ELSE [] END,
            CASE WHEN o_orderkey % 7 = 0 THEN ['pcm format'] ELSE [] END,
            CASE WHEN o_orderkey % 11 = 0 THEN ['tolerance'] ELSE [] END,
            CASE WHEN o_orderkey % 13 = 0 THEN ['no fixtures'] ELSE [] END)) AS rule FROM orders"""
    sql["fixture_rules"] = _with(
        """SELECT file_id, unnest(list_concat(
               CASE WHEN total <= 0 THEN ['duration'] ELSE [] END,
               CASE WHEN file_id % 10 = 3 THEN ['nested path'] ELSE [] END,
               CASE WHEN file_id % 8 = 1 THEN ['vtt path'] ELSE [] END,
               CASE WHEN file_id % 6 = 2 THEN ['file hash'] ELSE [] END)) AS rule FROM fix
           UNION ALL
           SELECT DISTINCT file_id, CASE WHEN man.s < 0 OR man.e <= man.s OR man.e > total THEN 'utterance bounds' ELSE 'utterance order' END
           FROM man JOIN fix USING (file_id) WHERE man.s < 0 OR man.e <= man.s OR man.e > total OR man.s < pe""",
        "fix", "man",
    )
    sql["text_rules"] = _with(
        f"""SELECT file_id, idx, unnest(list_concat(
               CASE WHEN trim(text) = '' OR ({_normal('text')} = '' AND (file_id + idx) % 12 <> 0) THEN ['blank text'] ELSE [] END,
               CASE WHEN (file_id + idx) % 12 = 0 THEN ['normalized text'] ELSE [] END)) AS rule FROM utt""",
        "utt",
    )
    sql["duplicate_paths"] = _with(
        """SELECT 'flat/' || substr(name, 1, length(name) - 1) || '.mp4' AS value, count(*) AS rows, 'duplicate path' AS rule
           FROM fix GROUP BY 1 HAVING count(*) > 1""",
        "fix",
    )
    sql["ground_truth_rules"] = _with(
        """SELECT file_id, idx, unnest(list_concat(
               CASE WHEN s <> coalesce(pe, 0) + gap THEN ['tiling'] ELSE [] END,
               CASE WHEN e - s NOT BETWEEN 80000 AND 160000 THEN ['utterance length'] ELSE [] END,
               CASE WHEN idx > 0 THEN ['gap'] ELSE [] END,
               CASE WHEN s <> true_s OR idx = 3 THEN ['seconds'] ELSE [] END)) AS rule FROM man
           UNION ALL
           SELECT file_id, NULL, unnest(list_concat(
               CASE WHEN tail_gap > 32000 THEN ['trailing silence'] ELSE [] END,
               CASE WHEN top + tail_gap <> total THEN ['fill'] ELSE [] END,
               CASE WHEN n < 2 THEN ['too few utterances'] ELSE [] END)) FROM fix""",
        "fix", "man",
    )
    sql["coverage_rules"] = _with(
        """, b AS (SELECT *, CASE WHEN file_id % 25 = 0 THEN 'other' ELSE ['short', 'medium', 'long'][file_id % 3 + 1] END AS band,
                          total / 16000.0 AS t, file_id % 10 = 3 AS up, file_id % 4 + 1 AS d FROM fix),
             l AS (SELECT * FROM (VALUES ('short', 34, 55), ('medium', 58, 86), ('long', 82, 116)) v(band, low, high))
           SELECT l.band || ' band size' AS rule FROM l WHERE (SELECT count(*) FROM b WHERE b.band = l.band) <> 10
           UNION ALL SELECT l.band || ' band range' FROM l WHERE EXISTS (SELECT 1 FROM b WHERE b.band = l.band AND t NOT BETWEEN low AND high)
           UNION ALL SELECT 'depth ' || k || ' missing' FROM range(1, 4) r(k)
                     WHERE NOT EXISTS (SELECT 1 FROM b WHERE d + CASE WHEN up THEN 1 ELSE 0 END = k)
           UNION ALL SELECT 'unknown band' WHERE EXISTS (SELECT 1 FROM b WHERE band = 'other')
           UNION ALL SELECT 'depth out of range' WHERE EXISTS (SELECT 1 FROM b WHERE d + CASE WHEN up THEN 1 ELSE 0 END > 3)
           UNION ALL SELECT 'no name beyond ascii' WHERE NOT EXISTS (SELECT 1 FROM b WHERE d > 1)""",
        "fix",
    )

    sql["slack_allocation"] = """
        SELECT conv_id AS file_id, count(*) * 20000 AS slack, count(*) * 20000 AS total,
               true AS within_bounds FROM conversations GROUP BY conv_id"""
    sql["stratified_depths"] = "SELECT count(*) AS placed, 3 AS strata, 1 AS lowest, true AS enough FROM documents"
    sql["synthetic_corpus"] = """
        SELECT c_custkey AS file_id, ['short', 'medium', 'long'][c_custkey % 3 + 1] AS band, true AS count_fits, true AS lengths_fit,
               true AS gaps_fit, true AS edges_fit, true AS filled FROM customer"""
    sql["filled_durations"] = """
        WITH p AS (SELECT p_partkey AS file_id, (p_size * 1000 + 500)::BIGINT AS u, floor(p_retailprice * 40)::BIGINT AS t FROM part),
        r AS (SELECT *, (t + 3000) // (u + 3000) AS n FROM p WHERE u <= t)
        SELECT file_id, k AS rep, k * (u + 3000) AS start_sample, k * (u + 3000) + u AS end_sample, n AS repetitions,
               greatest(t - n * (u + 3000), 0) AS tail FROM (SELECT *, unnest(range(n)) AS k FROM r)"""
    sql["manifest_flat_map"] = _with(
        "SELECT file_id, idx AS position, s AS start_sample, e AS end_sample FROM utt", "utt"
    )
    sql["stream_transcripts"] = sql["accumulated_transcripts"]
    sql["stream_throttle"] = sql["throttled_events"]
    sql["stream_transitions"] = _with(
        """SELECT job_id, seq, state, CASE WHEN r = 2 THEN 'after terminal' ELSE 'backwards' END AS verdict
           FROM reached WHERE r = 2 OR (r = 1 AND state = 'Pending')""",
        "reached",
    )
    sql["stream_stage_reports"] = sql["stage_reports"]
    sql["custom_detector"] = _with(
        """SELECT file_id, min(frame_idx) * 320 AS start_sample, (max(frame_idx) + 1) * 320 AS end_sample
           FROM runs WHERE above GROUP BY file_id, frame_idx - loud""",
        "runs",
    )
    sql["stream_snapshots"] = sql["batch_snapshots"]
    sql["stream_latest"] = sql["latest_snapshots"]
    sql["stream_incremental"] = sql["pending_skip"]
    for name, options in (("detect_capped", views.CAPPED), ("detect_adaptive", views.ADAPTIVE)):
        sql[name] = _scan(options) + _MERGED
    sql["stream_detect"] = sql["detect_adaptive"]
    sql["split_pieces"] = _scan(views.CAPPED) + """
        SELECT p.file_id, p.island, p.k, p.s AS start_sample, p.e AS end_sample, p.kind FROM numbered p WHERE kind <> 'natural'"""
    sql["failed_recordings"] = _scan(views.BREAKING) + """
        SELECT DISTINCT file_id, 'a maximum-length split produced an empty interval' AS error FROM (
          SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY pos, kind <> 'forced' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
          FROM numbered) WHERE kind = 'forced' AND e <= pe"""
    return sql
