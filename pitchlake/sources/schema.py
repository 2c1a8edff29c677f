"""Explicit schemas of every table and document read or written."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
OBJECT = "struct<track_id:bigint,bbox:array<double>,class_id:int,class_name:string,team_id:int>"
FRAME_RECORD = f"struct<frame:bigint,objects:array<{OBJECT}>,ball_owner:bigint,possession_team:int>"
DETECTION_DOCUMENT = f"map<string,{FRAME_RECORD}>"
POSITION = ("frame bigint, timestamp double, player_id bigint, team_id int, bbox array<double>, "
            "position array<double>, field_position array<double>, zone_id int")
EVENT = ("type string, frame bigint, timestamp double, team int, from_team int, to_team int, from_player bigint, "
         "to_player bigint, player_id bigint")
CHUNK_STATS = ("batch_idx bigint, start_frame bigint, end_frame bigint, processing_time_ms double, "
               "chunk_stats struct<frames_processed:bigint,detections_count:bigint,events_count:bigint,"
               "possession_team:int,possession_player:bigint>")
_TRACKS = "map<string,struct<id:bigint,team_id:int>>"
MATCH_STATE = (
    "match_id string, source_type string, source_url string, fps double, status string, "
    "total_frames_processed bigint, last_batch_idx bigint, last_update string, "
    f"tracker_state struct<active_tracks:{_TRACKS},next_id:bigint,last_frame_idx:bigint>, "
    "team_classifier_state struct<player_team_map:map<string,int>,team_colors:map<string,array<double>>,is_trained:boolean>, "
    "possession_state struct<current_team:int,current_player:bigint,frames_by_team:map<string,bigint>,"
    "passes_by_team:map<string,bigint>>")
_POINT = "array<struct<frame:bigint,track_id:bigint,position:array<double>,method:string>>"
HEATMAP_POINTS = f"team_0 {_POINT}, team_1 {_POINT}"

#: Column that names the folders of packed tables.
BUCKET = "match_bucket"
