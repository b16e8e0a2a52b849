from barflow.operators.structure import config
from barflow.operators.structure.config import PointRules, StructureConfig
from barflow.operators.structure.replay import compact, strokes_at, stroke_versions, structure_at, window_strokes
from barflow.operators.structure.tables import Structure, build, fractals, gap_to_next, merged_bars, of_strokes
