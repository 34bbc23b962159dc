"""Named pipelines. Steps are names of operators; parameters are those of the fullest one unless said otherwise."""

from __future__ import annotations

from .pipeline import Step

#: Parameters of the published pipelines (fixed values).
_PARAMS = {
    "intensity:tissue": {"name": "bright", "upper_threshold": ".9", "lower_std": "10"},
    "intensity:dark": {"name": "dark", "upper_threshold": ".15", "invert": "true"},
    "minimum_neighbourhood": {"disk_size": "5", "upper_threshold": "210", "invert": "True"},
    "smoothness": {"threshold": ".01", "kernel_size": "10", "min_object_size": "500"},
    "fat_like": {"kernel_size": "10", "max_keep_size": "1000", "fat_cell_size": "64"},
    "fill_holes": {"min_size": "1000"},
    "remove_small": {"min_size": "64"},
    "texture:background": {"prefix": "background", "patch_size": "32", "npatches": "1000", "nlevels": "8", "invert": "True"},
    "texture:final": {"prefix": "final", "patch_size": "32", "npatches": "1000", "nlevels": "8"},
    "contrast:background": {"prefix": "background", "invert": "True"},
    "brightness:background": {"prefix": "background", "invert": "True"},
    "channel_brightness:background": {"prefix": "background", "invert": "True"},
    "channel_brightness:YUV": {"to_color_space": "YUV"},
    "blur": {"blur_radius": "7", "blur_threshold": ".15"},
    "spur": {"disk_radius": "5"},
    "area": {"area_threshold": "10000"},
    "template_distance": {"bins": "20"},
    "histogram": {"bins": "20"},
    "stains": {"stain": "hed_from_rgb"},
    "final": {"mask_statistics": "absolute"},
}
_COLOUR = "template_distance histogram contrast brightness channel_brightness:RGB channel_brightness:YUV stains"
_CLEAN = "fat_like fill_holes remove_small"
_END = "keep final"

#: Order of steps of the published pipelines (fixed values). Classifier steps of these pipelines need exemplar pictures and are added by the caller.
_STEPS = {
    "default": f"basic_stats intensity:tissue intensity:dark smoothness {_CLEAN} blur spur area {_COLOUR} {_END}",
    "light": f"basic_stats intensity:tissue smoothness intensity:dark fill_holes remove_small blur spur area {_END}",
    "first": f"basic_stats intensity:tissue contrast:background brightness:background channel_brightness:background {_COLOUR.removesuffix(' stains')} {_END}",
    "clinical": f"basic_stats intensity:tissue intensity:dark smoothness keep_named:first {_CLEAN} keep_named:second blur spur area {_COLOUR.removesuffix(' stains')} keep_named:third stains {_END}",
    "ihc": f"basic_stats equalise minimum_neighbourhood fill_holes remove_small texture:background contrast:background brightness:background channel_brightness:background texture:final contrast brightness channel_brightness:RGB channel_brightness:YUV stains histogram {_END}",
    "v2.1": f"basic_stats equalise minimum_neighbourhood intensity:dark smoothness {_CLEAN} texture:background contrast:background brightness:background channel_brightness:background blur spur area template_distance histogram texture:final contrast brightness channel_brightness:RGB channel_brightness:YUV stains keep pieces final",
}


def names() -> list[str]:
    return sorted(_STEPS)


def preset(name: str, **changes: dict[str, str]) -> list[Step]:
    """The steps of a pipeline; changes: parameters by step (with its label after two underscores)."""
    if name not in _STEPS:
        raise KeyError(name)
    steps = []
    for key in _STEPS[name].split():
        op, _, label = key.partition(":")
        own = dict(_PARAMS.get(key, _PARAMS.get(op, {}) if not label else {}))
        if op == "keep_named":
            own = {"suffix": f"mask_{label}"}
        own |= changes.get(key.replace(":", "__"), {})
        steps.append(Step(op, label or None, own))
    return steps
