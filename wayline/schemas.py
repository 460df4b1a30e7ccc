"""Schemas of the tables that the operators read and write."""

_BOX = "x1 double, y1 double, x2 double, y2 double"
_KEY = "stream_id string, run_id string"
FRAMES = f"{_KEY}, frame_index long, timestamp double, wall_ts double, width int, height int"
DETECTIONS = f"{_KEY}, frame_index long, timestamp double, det_idx int, {_BOX}, score double, class_id int, class_name string, vehicle_class string"
TRACK_FRAMES = f"{_KEY}, track_id long, frame_index long, timestamp double, state string, matched boolean, {_BOX}, vehicle_class string, score double, hits long, class_confidence double"
FINISHED = f"{_KEY}, track_id long, frame_index long, timestamp double, vehicle_class string, confirmed boolean, hits long"
LINES = "stream_id string, line_id string, name string, ax double, ay double, bx double, by double, classes array<string>, forward_label string, backward_label string, ord int"
ZONES = "stream_id string, zone_id string, name string, points array<struct<x:double,y:double>>, classes array<string>, dwell_alert_s double, ord int"
CALIBRATION_POINTS = "stream_id string, image_x double, image_y double, ground_x double, ground_y double"
CALIBRATIONS = "stream_id string, h array<double>, inverse array<double>"
WATCHLISTS = "watchlist_id string, name string, plate string"
RULES = "rule_id string, name string, enabled boolean, when_json string, actions_json string, cooldown_s double, streams array<string>, ord int"
VEHICLE_CLASSES = ("car", "van", "bus", "truck", "motorcycle", "bicycle", "emergency", "person", "other")
TRACK_STATES = ("tentative", "active", "lost", "finished")
EVENT_TYPES = (
    "track_started", "track_finished", "line_crossed", "zone_entered", "zone_exited", "zone_dwell", "speeding", "wrong_way",
    "stopped_vehicle", "plate_read", "watchlist_hit", "rule_triggered", "stream_started", "stream_ended", "stream_error",
)
#: Payload of an event; every field may be null.
DATA = (
    "class string, duration_s double, distance_m double, avg_speed_kmh double, max_speed_kmh double, plate string, plate_confidence double, color string, n_points long, "
    "first_wall_ts double, last_wall_ts double, line string, line_name string, direction string, direction_canonical string, count long, zone string, zone_name string, "
    "dwell_s double, speed_kmh double, limit_kmh double, confidence double, corrected boolean, country string, valid boolean, watchlist string, watchlist_id string, watchlist_name string, rule_name string, trigger string"
)
EVENTS = f"id string, type string, {_KEY}, timestamp double, wall_ts double, track_id long, rule_id string, vehicle_class string, data struct<{','.join(':'.join(f.split(' ', 1)) for f in DATA.split(', '))}>, snapshot_path string, frame_index long, phase int, geom_ord int"
