"""Site-specific values, passed as one argument instead of module constants."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteProfile:
    """Addresses, placeholders and markers of the directory being catalogued."""

    base_url: str = "https://directory.example.com"
    asset_url: str = "https://assets.example.com/screenshots"
    # Host that serves genuine listing images, see logos.score_directory.
    image_host: str = "assets.example.com"
    # Values the directory shows when a listing has none of its own.
    placeholder_email: str = "desk@directory.example.com"
    placeholder_image: str = "logo.f3a91ce.png"
    placeholder_image_path: str = "/2.9.4/img/logo.f3a91ce.png"
    listing_path: str = "/ai-tools/"
    grid_category: str = "Advertising Assistant"
    no_results_text: str = "No Results Found"

    @property
    def placeholders(self) -> dict[str, str]:
        """Field name to placeholder value; other fields use the empty string."""
        return {
            "image_url": self.placeholder_image_path,
            "support_email": self.placeholder_email,
        }
