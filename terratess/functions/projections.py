"""Closed-form map projections on the WGS84/GRS80 ellipsoid as column expressions; no datum shifts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


@dataclass(frozen=True)
class Utm:
    """Transverse Mercator by Krueger's series to the fourth order in the third flattening."""

    zone: int
    north: bool = True

    @property
    def crs(self) -> str:
        return f"+proj=utm +zone={self.zone} {'' if self.north else '+south '}+datum=WGS84 +units=m"

    def _terms(self):
        n = FLATTENING / (2 - FLATTENING)
        r = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        to = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        return r, to, back

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        r, to, _ = self._terms()
        phi, lam = F.radians(lat), F.radians(lon - (6 * self.zone - 183))
        s = F.sin(phi)
        t = F.sinh(F.atanh(s) - E1 * F.atanh(E1 * s))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for k, a in enumerate(to, 1):
            x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
            y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        return 500_000 + 0.9996 * r * x, (0 if self.north else 10_000_000) + 0.9996 * r * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        r, _, back = self._terms()
        xi, eta = (y - (0 if self.north else 10_000_000)) / (0.9996 * r), (x - 500_000) / (0.9996 * r)
        xp, ep = xi, eta
        for k, b in enumerate(back, 1):
            xp = xp - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            ep = ep - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        chi = F.asin(F.sin(xp) / F.cosh(ep))
        # isometric latitude back to geographic
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(6)), chi, lambda p, _: F.asin(F.tanh(F.atanh(F.sin(chi)) + E1 * F.atanh(E1 * F.sin(p)))))
        return F.degrees(F.atan2(F.sinh(ep), F.cos(xp))) + (6 * self.zone - 183), F.degrees(phi)


@dataclass(frozen=True)
class Albers:
    """Albers equal-area conic; the defaults are the usual North American parameters."""

    south: float = 20.0
    north: float = 60.0
    lat0: float = 40.0
    lon0: float = -96.0

    @property
    def crs(self) -> str:
        return f"+proj=aea +lat_1={self.south} +lat_2={self.north} +lat_0={self.lat0} +lon_0={self.lon0} +datum=NAD83 +units=m"

    @staticmethod
    def _q(s: float) -> float:
        return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))

    def _cone(self):
        m = [math.cos(math.radians(p)) / math.sqrt(1 - E2 * math.sin(math.radians(p)) ** 2) for p in (self.south, self.north)]
        q = [self._q(math.sin(math.radians(p))) for p in (self.south, self.north, self.lat0)]
        n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
        c = m[0] ** 2 + n * q[0]
        return n, c, A * math.sqrt(c - n * q[2]) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._cone()
        s = F.sin(F.radians(lat))
        q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
        rho, theta = A * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._cone()
        rho = F.sqrt(x * x + (rho0 - y) * (rho0 - y))
        q = (c - rho * rho * n * n / (A * A)) / n

        def step(phi: Column, _: Column) -> Column:
            s = F.sin(phi)
            w = 1 - E2 * s * s
            return phi + w * w / (2 * F.cos(phi)) * (q / (1 - E2) - s / w + F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))

        phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.asin(q / 2), step)
        return F.degrees(F.atan2(x, rho0 - y) / n) + self.lon0, F.degrees(phi)


@dataclass(frozen=True)
class Geographic:
    """Degrees as they are."""

    crs: str = "+proj=longlat +datum=WGS84"

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x, y


#: EPSG and ESRI codes of geographic systems.
_DEGREES = {4326, 4269, 4258, 4979, 4617}


def _coded(code: int):
    if code in _DEGREES:
        return Geographic()
    if 32601 <= code <= 32660 or 26901 <= code <= 26923 or 25828 <= code <= 25838:
        return Utm(code % 100)
    if 32701 <= code <= 32760:
        return Utm(code % 100, False)
    return Albers() if code == 102008 else None


def _of_proj4(text: str):
    given = {k: v for k, v in re.findall(r"\+(\w+)(?:=(\S+))?", text)}
    kind = given.get("proj")
    if kind in ("longlat", "latlong", "lonlat"):
        return Geographic()
    if kind == "utm":
        return Utm(int(given["zone"]), "south" not in given)
    if kind == "aea":
        return Albers(*(float(given.get(k, 0.0)) for k in ("lat_1", "lat_2", "lat_0", "lon_0")))
    return None


def _of_words(text: str):
    """Well-known text, or a name as rasters carry it."""
    plain = text.replace("_", " ")
    if m := re.search(r"UTM zone (\d+) ?([NS])?", plain, re.IGNORECASE):
        return Utm(int(m[1]), (m[2] or "N").upper() == "N")
    if re.search("albers", plain, re.IGNORECASE):
        given = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+.\deE]+)', text)}
        if not given:
            return None
        pick = lambda default, *names: next((given[n] for n in names if n in given), default)
        return Albers(pick(0.0, "standard_parallel_1"), pick(0.0, "standard_parallel_2"), pick(0.0, "latitude_of_center", "latitude_of_origin"), pick(0.0, "longitude_of_center", "central_meridian"))
    if re.search(r"PROJC(S|RS)\[", text):
        return None
    return Geographic() if re.search(r"GEOGC(S|RS)\[|^(WGS ?84|NAD ?83|GCS)|OGC:.*CRS84", plain, re.IGNORECASE) else None


def of(crs: str):
    """The projection that a coordinate system names: a proj4 string, an EPSG or ESRI code, well-known text or its usual name. Others are an error."""
    text = " ".join(crs.split())
    if m := re.search(r"^(?:EPSG|ESRI):(\d+)$|[:/](?:EPSG|ESRI)(?::|/)+(?:[\d.]*[:/])?(\d+)$", text, re.IGNORECASE):
        found = _coded(int(m[1] or m[2]))
    else:
        found = _of_proj4(text) if "+proj" in text else _of_words(text)
    if found is None:
        raise ValueError(f"the coordinate system {crs!r} is not one that can be projected")
    return found


def known(crs: str) -> bool:
    try:
        return bool(of(crs))
    except ValueError:
        return False


def same(a: str, b: str) -> bool:
    """Whether two coordinate systems agree, datums aside; unknown ones agree only with themselves."""
    if a == b:
        return True
    try:
        return of(a) == of(b)
    except ValueError:
        return False


def geographic(crs: str) -> bool:
    try:
        return isinstance(of(crs), Geographic)
    except ValueError:
        return False


def between(source: str, target: str):
    """A function of columns (x, y) from one coordinate system to another, through degrees."""
    a, b = of(source), of(target)
    return lambda x, y: b.forward(*a.inverse(x, y))
