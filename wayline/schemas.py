"""Relations of the engine as Spark DDL."""

IMU = ("accel_x", "accel_y", "accel_z", "gyro_x", "gyro_y", "gyro_z")

SAMPLES = (
    "session_id STRING, seq BIGINT, time_ms DOUBLE, accel_x FLOAT, accel_y FLOAT, accel_z FLOAT, gyro_x FLOAT, gyro_y FLOAT, "
    "gyro_z FLOAT, orient_yaw DOUBLE, orient_pitch DOUBLE, orient_roll DOUBLE"
)
VEHICLE_SAMPLES = (
    "session_id STRING, seq BIGINT, time_s DOUBLE, lat DOUBLE, lon DOUBLE, velocity_kmh DOUBLE, heading_deg DOUBLE, "
    "indicated_speed_kmh DOUBLE"
)
STEPS = (
    "session_id STRING, i BIGINT, t_s DOUBLE, speed_ms DOUBLE, gyro_z DOUBLE, gt_lat DOUBLE, gt_lon DOUBLE, gt_heading_deg DOUBLE"
)
INTERVALS = "session_id STRING, duration_s INT, interval_idx INT, start_s DOUBLE, end_s DOUBLE"
ROAD_VERTICES = "road_id STRING, seq INT, e DOUBLE, n DOUBLE"
SENSOR_EVENTS = "device STRING, sensor STRING, ts_ns BIGINT, values ARRAY<FLOAT>"
GNSS_FIXES = "device STRING, ts_ns BIGINT, lat DOUBLE, lon DOUBLE, alt DOUBLE"
OUTAGE_COMMANDS = "device STRING, ts_ns BIGINT, cmd STRING"
