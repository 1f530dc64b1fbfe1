"""Configurations and their checks, and the schemas of stored tables."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "dataset_id string, record_id string, smiles string"
FINGERPRINT = "struct<indices:array<int>,counts:array<int>,size:int>"
ENCODING = "smiles string, count_tanimoto float, binary_tanimoto float, log_mse float, latent array<float>"
SHARD_ROW = "cid long, indices array<int>, counts array<int>, descriptor_targets array<float>, split string"


@dataclass(frozen=True)
class QualityFilter:
    """Inclusive bounds; None leaves one out."""

    min_heavy_atoms: int | None = None
    max_heavy_atoms: int | None = None
    min_mass: float | None = None
    max_mass: float | None = None
    min_charge: int | None = None
    max_charge: int | None = None
    max_components: int | None = None

    def __post_init__(self):
        for low, high in ((self.min_heavy_atoms, self.max_heavy_atoms), (self.min_mass, self.max_mass), (self.min_charge, self.max_charge)):
            if low is not None and high is not None and low > high:
                raise ValueError(f"bounds are inverted: {low} and {high}")
        for mass in (self.min_mass, self.max_mass):
            if mass is not None and (not math.isfinite(mass) or mass < 0):
                raise ValueError(f"a mass bound must be finite and not negative: {mass}")
        if self.max_components == 0:
            raise ValueError("max_components must be positive")

    @property
    def active(self) -> bool:
        return any(v is not None for v in asdict(self).values())

    def accepts(self, d: Column) -> Column:
        """d: the descriptors' struct."""
        tests = [
            (self.min_heavy_atoms, lambda b: d["heavy_atom_count"] < b),
            (self.max_heavy_atoms, lambda b: d["heavy_atom_count"] > b),
            (self.min_mass, lambda b: d["molecular_mass"] < b),
            (self.max_mass, lambda b: (d["molecular_mass"] > b) & ~F.isnan(d["molecular_mass"])),
            (self.min_charge, lambda b: d["formal_charge"] < b),
            (self.max_charge, lambda b: d["formal_charge"] > b),
            (self.max_components, lambda b: d["connected_component_count"] > b),
        ]
        out = F.lit(True)
        for bound, fails in tests:
            if bound is not None:
                out = out & ~fails(bound)
        return out


@dataclass(frozen=True)
class Preprocessing:
    radius: int = 2
    fingerprint_size: int = 4096
    validation_permille: int = 100
    quality: QualityFilter = field(default_factory=QualityFilter)

    def __post_init__(self):
        if not 0 <= self.validation_permille <= 1000:
            raise ValueError("validation_permille must be 0 to 1000")
        if not 0 < self.fingerprint_size <= 65536 or not 1 <= self.radius <= 255:
            raise ValueError("fingerprint_size must be 1 to 65536 and radius 1 to 255")


@dataclass(frozen=True)
class Losses:
    """Weights and shapes of the four loss terms; a term of weight 0 is off."""

    huber_beta: float = 1.0
    huber_active: float = 1.0
    huber_zero: float = 0.05
    bce_weight: float = 1.0
    bce_active: float = 1.0
    bce_zero: float = 4.0
    descriptor_weight: float = 0.05
    ranking_weight: float = 0.10
    latent_temperature: float = 0.05
    metric_temperature: float = 0.10
    min_gap: float = 0.05
    candidates: int = 32
    pairs_per_batch: int = 0

    def __post_init__(self):
        positive = (self.huber_beta, self.latent_temperature, self.metric_temperature)
        if not all(math.isfinite(x) and x > 0 for x in positive):
            raise ValueError("beta and temperatures must be finite and positive")
        weights = (self.huber_active, self.huber_zero, self.bce_weight, self.bce_active, self.bce_zero, self.descriptor_weight, self.ranking_weight, self.min_gap, self.pairs_per_batch)
        if not all(math.isfinite(x) and x >= 0 for x in weights):
            raise ValueError("weights must be finite and not negative")
        if self.ranking_weight > 0 and self.candidates < 2:
            raise ValueError("the ranking term needs two candidates at least")


#: The keys of a stored configuration's parts, and the fields here that they hold.
LOSS_KEYS = {
    "reconstruction_loss": {"beta": "huber_beta", "zero_weight": "huber_zero", "nonzero_weight": "huber_active", "bce_weight": "bce_weight", "bce_zero_weight": "bce_zero", "bce_nonzero_weight": "bce_active"},
    "auxiliary_weights": {"descriptors": "descriptor_weight", "tanimoto_ranking": "ranking_weight"},
    "tanimoto_ranking": {"latent_temperature": "latent_temperature", "metric_temperature": "metric_temperature", "min_gap": "min_gap", "candidates_per_anchor": "candidates", "pairs_per_batch": "pairs_per_batch"},
}
#: Older names of the latent temperature.
OLD_TEMPERATURES = ("margin", "tanimoto_ranking_margin")


@dataclass(frozen=True)
class Model:
    """Encoder widths from the fingerprint to the latent vector; the decoder's mirror them unless given."""

    fingerprint_size: int = 4096
    descriptor_width: int = 18
    latent_width: int = 512
    hidden_widths: tuple[int, ...] = (4096, 2048, 1024)
    ecfp_radius: int = 2
    latent_noise_std: float = 0.02
    bit_frequencies: tuple[float, ...] = ()
    losses: Losses = field(default_factory=Losses)
    decoder_widths: tuple[int, ...] = ()

    def __post_init__(self):
        if not self.decoder_widths:
            object.__setattr__(self, "decoder_widths", self.hidden_widths[::-1])
        if not self.hidden_widths or min(self.fingerprint_size, self.descriptor_width, self.latent_width, *self.hidden_widths, *self.decoder_widths) < 1:
            raise ValueError("widths must be positive, and there must be a hidden one")
        if not math.isfinite(self.latent_noise_std) or self.latent_noise_std < 0:
            raise ValueError("the noise must be finite and not negative")
        if not 1 <= self.ecfp_radius <= 255:
            raise ValueError("ecfp_radius must be 1 to 255")
        if self.bit_frequencies and (len(self.bit_frequencies) != self.fingerprint_size or not all(0 <= p <= 1 for p in self.bit_frequencies)):
            raise ValueError("bit_frequencies must have one probability for each bin")

    def to_json(self) -> str:
        out = {
            "encoder": {"input_width": self.fingerprint_size, "hidden_widths": self.hidden_widths, "latent_width": self.latent_width},
            "decoder": {"latent_width": self.latent_width, "hidden_widths": self.decoder_widths, "output_width": self.fingerprint_size},
            "descriptor_width": self.descriptor_width,
        }
        out |= {part: {k: getattr(self.losses, name) for k, name in keys.items()} for part, keys in LOSS_KEYS.items()}
        return json.dumps(out | {"latent_noise_std": self.latent_noise_std, "ecfp_radius": self.ecfp_radius, "bit_frequencies": self.bit_frequencies}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Model:
        """Missing keys take their defaults, and older names of the temperature count; widths that don't fit together are errors."""
        raw = json.loads(text)
        encoder, decoder, losses = raw.get("encoder", {}), raw.get("decoder", {}), {}
        for part, keys in LOSS_KEYS.items():
            own = dict(raw.get(part, {}))
            for old in OLD_TEMPERATURES if part == "tanimoto_ranking" else ():
                if old in own:
                    own.setdefault("latent_temperature", own.pop(old))
            losses |= {name: own[k] for k, name in keys.items() if k in own}
        size, latent = encoder.get("input_width", cls.fingerprint_size), encoder.get("latent_width", cls.latent_width)
        if decoder.get("output_width", size) != size or decoder.get("latent_width", latent) != latent:
            raise ValueError("widths of encoder and decoder differ")
        plain = {k: raw[k] for k in ("descriptor_width", "latent_noise_std", "ecfp_radius") if k in raw}
        return cls(
            fingerprint_size=size, latent_width=latent, hidden_widths=tuple(encoder.get("hidden_widths", cls.hidden_widths)), decoder_widths=tuple(decoder.get("hidden_widths", ())),
            bit_frequencies=tuple(raw.get("bit_frequencies", ())), losses=Losses(**losses), **plain,
        )
