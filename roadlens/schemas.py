"""Fixed schemas of the component tables, by tag.  A table's grain is its set of ``key.`` columns."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, I, L, FL, D, BIN, BO = T.StringType(), T.ByteType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.BinaryType(), T.BooleanType()
A = T.ArrayType

SEGMENT = [("segment_context_name", S)]
FRAME = [*SEGMENT, ("frame_timestamp_micros", L)]
LASER = [*FRAME, ("laser_name", B)]
CAMERA = [*FRAME, ("camera_name", B)]
BOX3 = [(f"box.{p}.{a}", D) for p, axes in (("center", "xyz"), ("size", "xyz")) for a in axes] + [("box.heading", D)]
BOX2 = [(f"box.{p}.{a}", D) for p in ("center", "size") for a in "xy"]
VELOCITY = [(f"{p}.{a}", D) for p in ("speed", "acceleration") for a in "xyz"]
DIFFICULTY = [("difficulty_level.detection", B), ("difficulty_level.tracking", B)]


def _tensor(name: str, kind: T.DataType, returns: int = 0) -> list:
    """A tensor is its flat values and its shape; lidar returns repeat it."""
    names = [f"{name}_return{i}" for i in range(1, returns + 1)] if returns else [name]
    return [x for n in names for x in ((f"{n}.values", A(kind)), (f"{n}.shape", A(I)))]


_PARTS = {
    "lidar_box": ("LiDARBoxComponent", [*FRAME, ("laser_object_id", S)], [*BOX3, ("type", B), ("num_lidar_points_in_box", L), ("num_top_lidar_points_in_box", L), *VELOCITY, *DIFFICULTY]),
    "lidar_camera_synced_box": ("LiDARCameraSyncedBoxComponent", [*FRAME, ("laser_object_id", S)], [("most_visible_camera_name", B), *((n.replace("box.", "camera_synced_box."), t) for n, t in BOX3)]),
    "projected_lidar_box": ("ProjectedLiDARBoxComponent", [*FRAME, ("laser_object_id", S), ("camera_name", B)], [*BOX2, ("type", B)]),
    "camera_box": ("CameraBoxComponent", [*CAMERA, ("camera_object_id", S)], [*BOX2, ("type", B), *DIFFICULTY]),
    "camera_to_lidar_box_association": ("CameraToLiDARBoxAssociationComponent", [*CAMERA, ("camera_object_id", S), ("laser_object_id", S)], []),
    "camera_image": ("CameraImageComponent", CAMERA, [("image", BIN), ("pose.transform", A(D)), *((f"velocity.{k}_velocity.{a}", D) for k in ("linear", "angular") for a in "xyz"), ("pose_timestamp", D), *((f"rolling_shutter_params.{x}", D) for x in ("shutter", "camera_trigger_time", "camera_readout_done_time"))]),
    "camera_calibration": ("CameraCalibrationComponent", [*SEGMENT, ("camera_name", B)], [*((f"intrinsic.{x}", D) for x in ("f_u", "f_v", "c_u", "c_v", "k1", "k2", "p1", "p2", "k3")), ("extrinsic.transform", A(D)), ("width", I), ("height", I), ("rolling_shutter_direction", B)]),
    "lidar_calibration": ("LiDARCalibrationComponent", [*SEGMENT, ("laser_name", B)], [("extrinsic.transform", A(D)), ("beam_inclination.min", D), ("beam_inclination.max", D), ("beam_inclination.values", A(D))]),
    "stats": ("StatsComponent", FRAME, [("time_of_day", S), ("location", S), ("weather", S), *((f"{k}_object_counts.{x}", A(t)) for k in ("lidar", "camera") for x, t in (("types", B), ("counts", I)))]),
    "lidar": ("LiDARComponent", LASER, _tensor("range_image", FL, 2)),
    "lidar_camera_projection": ("LiDARCameraProjectionComponent", LASER, _tensor("range_image", I, 2)),
    "lidar_pose": ("LiDARPoseComponent", LASER, _tensor("range_image_return1", FL)),
    "lidar_segmentation": ("LiDARSegmentationLabelComponent", LASER, _tensor("range_image", I, 2)),
    "camera_segmentation": ("CameraSegmentationLabelComponent", CAMERA, [("panoptic_label_divisor", I), ("panoptic_label", BIN), *((f"instance_id_to_global_id_mapping.{x}", A(t)) for x, t in (("local_instance_ids", I), ("global_instance_ids", I), ("is_tracked", BO))), ("sequence_id", S), ("num_cameras_covered", BIN)]),
    "camera_hkp": ("CameraHumanKeypointsComponent", [*CAMERA, ("camera_object_id", S)], [("camera_keypoints[*].type", A(B)), *((f"camera_keypoints[*].keypoint_2d.{x}", A(t)) for x, t in (("location_px.x", D), ("location_px.y", D), ("visibility.is_occluded", BO)))]),
    "lidar_hkp": ("LiDARHumanKeypointsComponent", [*FRAME, ("laser_object_id", S)], [("lidar_keypoints[*].type", A(B)), *((f"lidar_keypoints[*].keypoint_3d.{x}", A(t)) for x, t in (("location_m.x", D), ("location_m.y", D), ("location_m.z", D), ("visibility.is_occluded", BO)))]),
    "vehicle_pose": ("VehiclePoseComponent", FRAME, [("world_from_vehicle.transform", A(D))]),
    "object_asset_lidar_sensor": ("ObjectAssetLiDARSensorComponent", [*FRAME, ("laser_object_id", S)], _tensor("points_xyz", FL)),
    "object_asset_camera_sensor": ("ObjectAssetCameraSensorComponent", [*CAMERA, ("laser_object_id", S)], [("camera_region.center.x", I), ("camera_region.center.y", I), ("camera_region.size.x", I), ("camera_region.size.y", I), ("rgb_image", BIN), *_tensor("proj_points_dist", FL), *_tensor("proj_points_mask", FL)]),
    "object_asset_refined_pose": ("ObjectAssetRefinedPoseComponent", [*FRAME, ("laser_object_id", S)], [("box_from_vehicle.transform", A(D))]),
    "object_asset_auto_label": ("ObjectAssetAutoLabelComponent", [*CAMERA, ("laser_object_id", S)], [("semantic_mask", BIN), ("instance_mask", BIN), ("object_mask", BIN)]),
    "object_asset_ray": ("ObjectAssetRayComponent", [*CAMERA, ("laser_object_id", S)], [*_tensor("ray_origin", FL), *_tensor("ray_direction", FL)]),
    "object_asset_ray_compressed": ("ObjectAssetRayCompressedComponent", [*CAMERA, ("laser_object_id", S)], [("reference", BIN), ("quant_values", BIN), ("mask", BIN)]),
}
#: A table of per-point flow exists in the data but carries no tag.
_EXTRA = {"lidar_flow": ("LiDARFlowComponent", LASER, _tensor("range_image_flow", FL, 2))}


def _build(parts: tuple) -> T.StructType:
    name, key, payload = parts
    return T.StructType([*(T.StructField(f"key.{n}", t, False) for n, t in key), *(T.StructField(f"[{name}].{n}", t, True) for n, t in payload)])


COMPONENTS: dict[str, T.StructType] = {tag: _build(p) for tag, p in _PARTS.items()}
UNTAGGED: dict[str, T.StructType] = {tag: _build(p) for tag, p in _EXTRA.items()}

LABEL_TYPES = {0: "UNKNOWN", 1: "VEHICLE", 2: "PEDESTRIAN", 3: "SIGN", 4: "CYCLIST"}
OBJECT_TYPES = {0: "UNSET", 1: "VEHICLE", 2: "PEDESTRIAN", 3: "CYCLIST", 4: "OTHER"}
